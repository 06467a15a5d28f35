"""Built-in example data sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depotry.schema import POINTS

# Real coordinates, invented order volumes.
BENGALURU_12 = (
    ("Koramangala", 12.9352, 77.6245, 420), ("Indiranagar", 12.9784, 77.6408, 310), ("Jayanagar", 12.9250, 77.5938, 260), ("Whitefield", 12.9698, 77.7500, 540),
    ("Hebbal", 13.0358, 77.5970, 180), ("Electronic City", 12.8452, 77.6602, 610), ("Rajajinagar", 12.9916, 77.5526, 150), ("HSR Layout", 12.9116, 77.6473, 390),
    ("Yelahanka", 13.1007, 77.5963, 120), ("Marathahalli", 12.9591, 77.6974, 470), ("Banashankari", 12.9250, 77.5667, 230), ("Malleshwaram", 13.0035, 77.5709, 200),
)
DELHI_10 = (
    ("Connaught Place", 28.6304, 77.2177, 340), ("Karol Bagh", 28.6519, 77.1909, 290), ("Saket", 28.5245, 77.2066, 380), ("Dwarka", 28.5921, 77.0460, 520), ("Rohini", 28.7495, 77.0565, 460),
    ("Lajpat Nagar", 28.5677, 77.2433, 310), ("Vasant Kunj", 28.5200, 77.1591, 270), ("Noida Sec 18", 28.5707, 77.3260, 590), ("Gurugram Cyber", 28.4950, 77.0890, 640), ("Shahdara", 28.6730, 77.2890, 250),
)
MUMBAI_9 = (
    ("Andheri", 19.1197, 72.8468, 520), ("Bandra", 19.0596, 72.8295, 410), ("Dadar", 19.0178, 72.8478, 330), ("Powai", 19.1176, 72.9060, 290), ("Borivali", 19.2307, 72.8567, 380),
    ("Thane", 19.2183, 72.9781, 450), ("Navi Mumbai", 19.0330, 73.0297, 400), ("Colaba", 18.9067, 72.8147, 170), ("Malad", 19.1868, 72.8489, 360),
)
HYDERABAD_9 = (
    ("Banjara Hills", 17.4156, 78.4347, 330), ("Jubilee Hills", 17.4326, 78.4071, 300), ("Gachibowli", 17.4401, 78.3489, 580), ("HITEC City", 17.4435, 78.3772, 620), ("Kukatpally", 17.4849, 78.4138, 410),
    ("Secunderabad", 17.4399, 78.4983, 350), ("Ameerpet", 17.4374, 78.4487, 290), ("LB Nagar", 17.3457, 78.5522, 320), ("Kompally", 17.5370, 78.4870, 190),
)
CHENNAI_9 = (
    ("T. Nagar", 13.0418, 80.2341, 380), ("Adyar", 13.0012, 80.2565, 320), ("Velachery", 12.9815, 80.2180, 400), ("Anna Nagar", 13.0850, 80.2101, 350), ("Guindy", 13.0067, 80.2206, 290),
    ("Sholinganallur", 12.9010, 80.2279, 560), ("Mylapore", 13.0339, 80.2698, 260), ("Porur", 13.0381, 80.1565, 330), ("Ambattur", 13.1143, 80.1548, 300),
)
PUNE_9 = (
    ("Koregaon Park", 18.5362, 73.8939, 300), ("Hinjewadi", 18.5936, 73.7301, 610), ("Kothrud", 18.5074, 73.8077, 340), ("Viman Nagar", 18.5679, 73.9143, 380), ("Hadapsar", 18.5089, 73.9260, 420),
    ("Baner", 18.5590, 73.7868, 390), ("Camp", 18.5136, 73.8788, 250), ("Wakad", 18.5975, 73.7626, 360), ("Katraj", 18.4488, 73.8600, 220),
)
KOLKATA_9 = (
    ("Park Street", 22.5535, 88.3520, 320), ("Salt Lake", 22.5867, 88.4171, 480), ("New Town", 22.5800, 88.4600, 440), ("Ballygunge", 22.5254, 88.3661, 300), ("Howrah", 22.5958, 88.2636, 410),
    ("Behala", 22.4989, 88.3186, 290), ("Dum Dum", 22.6420, 88.4312, 270), ("Garia", 22.4620, 88.3900, 310), ("Rajarhat", 22.6190, 88.4530, 230),
)
CROSS_13 = (
    ("Hebbal", 13.0400, 77.5900, 310), ("Yeshwanthpur", 13.0285, 77.5462, 350), ("KRPuram", 12.9950, 77.6800, 420), ("Whitefield", 12.971389, 77.750130, 880), ("Marathahalli", 12.956194, 77.701943, 640),
    ("Indiranagar", 12.9699, 77.6499, 720), ("Koramangala", 12.9259, 77.6229, 950), ("BTMLayout", 12.9250, 77.60861, 610), ("Jayanagar", 12.9250, 77.5950, 480), ("Banashankari", 12.9373, 77.5543, 390),
    ("Kengeri", 12.9100, 77.4800, 230), ("ElectronicCity", 12.84649, 77.67112, 560), ("Sarjapur", 12.8600, 77.7860, 270),
)
EXACT_6 = (("N1", 12.9716, 77.5946, 120), ("N2", 12.9352, 77.6245, 80), ("N3", 12.9141, 77.6353, 150), ("N4", 12.9856, 77.5255, 90), ("N5", 12.9591, 77.7479, 200), ("N6", 13.0104, 77.5511, 60))
# Fixed value: a file whose headers no alias knows.
MESSY_CSV = """Locality Name,Y Coordinate,X Coordinate,Parcels Per Day,Manager
Koramangala,12.9352,77.6245,420,R. Iyer
Indiranagar,12.9784,77.6408,310,S. Nair
Jayanagar,12.9250,77.5938,260,A. Rao
Whitefield,12.9698,77.7500,540,M. Khan
Hebbal,13.0358,77.5970,180,P. Das
Electronic City,12.8452,77.6602,610,V. Menon
"""

SAMPLES = {
    "bengaluru_12": BENGALURU_12, "delhi_10": DELHI_10, "mumbai_9": MUMBAI_9, "hyderabad_9": HYDERABAD_9, "chennai_9": CHENNAI_9, "pune_9": PUNE_9, "kolkata_9": KOLKATA_9,
    "bengaluru_8": BENGALURU_12[:8], "small_4": BENGALURU_12[:4], "cross_13": CROSS_13, "exact_6": EXACT_6,
}


def sample(spark: SparkSession, *names: str) -> DataFrame:
    """Points of the named data sets, all of them if none is named."""
    rows = [(n, i, *r) for n in names or SAMPLES for i, r in enumerate(SAMPLES[n])]
    return spark.createDataFrame(rows, POINTS)
