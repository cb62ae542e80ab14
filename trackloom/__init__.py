"""Identity resolution and longitudinal signals over DataFrames."""
