"""What-if analyses composed from operators."""
