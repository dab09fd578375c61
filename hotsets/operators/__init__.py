"""Domain jobs, each a function DataFrame(s) -> DataFrame (lazy plans)."""
