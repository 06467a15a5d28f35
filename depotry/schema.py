"""Schemas, catalogues and the two cost profiles."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession

POINTS = "dataset string, ord long, id string, lat double, lon double, orders long"
SITES = "dataset string, k int, wh_ord int, wh_id string, lat double, lon double"

# Fleets (capacity in orders, litres and rupees a km, km/h, grams of CO2 a km).
VEHICLES = (
    ("bike", "Two-wheeler", 25, 0.020, 34.0, 0.9, 46.0, None),
    ("auto", "Three-wheeler", 60, 0.033, 28.0, 1.6, 76.0, None),
    ("van", "Van", 180, 0.085, 30.0, 3.4, 228.0, None),
    ("truck", "Truck", 420, 0.150, 26.0, 6.2, 402.0, None),
    ("ev", "Electric van", 150, 0.0, 30.0, 2.1, 142.0, 1.40),
)
# How many times longer a trip takes.
TRAFFIC = (("free", "Free flow", 1.00), ("light", "Light", 1.25), ("peak", "Peak", 1.85), ("gridlock", "Gridlock", 2.60))
# Growth everywhere and its tilt towards the edge (positive) or the centre.
SCENARIOS = (("today", "Today", 1.00, 0.0), ("growth", "Growth", 1.40, 0.0), ("sprawl", "Sprawl", 1.35, 0.9), ("infill", "Infill", 1.30, -0.7), ("downturn", "Downturn", 0.75, 0.0))
# Accepted ranges of what a link may set.
RANGES = {"k": (1, 8), "f": (40, 160), "w": (60, 400), "r": (500, 15000), "cap": (200, 4000), "rad": (2, 40)}


@dataclass(frozen=True)
class Profile:
    """What differs between the two models: Earth radius, form of the distance, radius test, best K."""

    name: str
    radius_km: float
    arc: str  # asin or atan2
    radius_on_road: bool
    best_k: str  # cheapest or elbow


RUPEE = Profile("rupee", 6371.0088, "asin", True, "cheapest")
ORDER_KM = Profile("order_km", 6371.0, "atan2", False, "elbow")
PROFILES = {p.name: p for p in (RUPEE, ORDER_KM)}


@dataclass(frozen=True)
class Config:
    """Constraints and prices; None is no limit."""

    capacity: int | None = None
    max_radius_km: float | None = None
    vehicle: str = "bike"
    traffic: str = "light"
    fuel_price: float = 111.0
    driver_wage: float = 120.0
    rent_per_day: float = 2500.0
    road_factor: float = 1.32
    #: Leave the energy of vehicles without fuel out of priced rows, as the rupee model once did; weights keep it.
    fuel_only_rows: bool = False

    def __post_init__(self) -> None:
        # Zero is no limit either.
        object.__setattr__(self, "capacity", self.capacity or None)
        object.__setattr__(self, "max_radius_km", self.max_radius_km or None)
        if self.vehicle not in {v[0] for v in VEHICLES} or self.traffic not in {t[0] for t in TRAFFIC}:
            raise ValueError(f"unknown vehicle or traffic: {self.vehicle}, {self.traffic}")

    def with_(self, **changes: object) -> Config:
        return replace(self, **changes)

    @property
    def fleet(self) -> dict[str, float | str | None]:
        names = ("id", "label", "capacity", "fuel_per_km", "speed_kmph", "upkeep_per_km", "co2_g_per_km", "energy_cost_per_km")
        return dict(zip(names, next(v for v in VEHICLES if v[0] == self.vehicle), strict=True))

    @property
    def congestion(self) -> float:
        return next(t[2] for t in TRAFFIC if t[0] == self.traffic)

    @property
    def energy_per_km(self) -> float:
        f = self.fleet
        return f["fuel_per_km"] * self.fuel_price if f["energy_cost_per_km"] is None else f["energy_cost_per_km"]

    @property
    def speed(self) -> float:
        return self.fleet["speed_kmph"] / self.congestion

    @property
    def rate_per_km(self) -> float:
        return self.energy_per_km + self.fleet["upkeep_per_km"] + self.driver_wage / self.speed

    def weight(self, orders: int) -> float:
        """Rupees a day for each straight-line km between a point and its site."""
        return 2 * -(-max(orders, 0) // max(self.fleet["capacity"], 1)) * self.road_factor * self.rate_per_km


def vehicles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(VEHICLES, "vehicle string, label string, capacity int, fuel_per_km double, speed_kmph double, upkeep_per_km double, co2_g_per_km double, energy_cost_per_km double")


def traffic(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TRAFFIC, "traffic string, label string, congestion double")


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "scenario string, label string, growth double, bias double")
