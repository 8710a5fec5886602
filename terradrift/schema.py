"""Names, types and fixed values of the point model."""

from __future__ import annotations

from pyspark.sql import types as T

# The delivery's metadata columns in order, with their types here.
META_TYPES: dict[str, T.DataType] = {
    "pid": T.StringType(),
    "mp_type": T.ByteType(),
    "latitude": T.DoubleType(),
    "longitude": T.DoubleType(),
    "easting": T.FloatType(),
    "northing": T.FloatType(),
    "height": T.FloatType(),
    "height_wgs84": T.FloatType(),
    "line": T.IntegerType(),
    "pixel": T.IntegerType(),
    "rmse": T.FloatType(),
    "temporal_coherence": T.FloatType(),
    "amplitude_dispersion": T.FloatType(),
    "incidence_angle": T.FloatType(),
    "track_angle": T.FloatType(),
    "los_east": T.FloatType(),
    "los_north": T.FloatType(),
    "los_up": T.FloatType(),
    "mean_velocity": T.FloatType(),
    "mean_velocity_std": T.FloatType(),
    "acceleration": T.FloatType(),
    "acceleration_std": T.FloatType(),
    "seasonality": T.FloatType(),
    "seasonality_std": T.FloatType(),
}
REQUIRED = ("pid", "track_angle", "latitude", "longitude")

# Time-series classes by number.
CLASSES = ("stable", "noisy", "linear", "accel", "decel", "variable", "other")
UNCLASSIFIED, NOISE = "unclassified", "NOISE"

# Display colour of each class.
COLORS = {
    "stable": "#2ecc71",
    "noisy": "#95a5a6",
    "linear": "#3498db",
    "accel": "#e74c3c",
    "decel": "#f39c12",
    "variable": "#9b59b6",
    "jump": "#e67e22",
    "other": "#1abc9c",
    "unclassified": "#555555",
    "mixed": "#ffffff",
}
NO_COLOR = "#cccccc"

# Grid cell in degrees by zoom level; a higher zoom counts as the last, an unknown one as 1e-5.
CELL_DEGREES = (4.0, 2.0, 1.0, 0.5, 0.25, 0.12, 0.06, 0.03, 0.015, 0.008, 0.004, 0.002, 0.001, 0.0005, 0.0001, 0.00001)

# The features of a series in order.
FEATURES = (
    "v_robust",
    "v_first_half",
    "v_second_half",
    "v_diff",
    "rmse_detrended",
    "rmse_deseason",
    "seasonal_amp",
    "seasonal_r2",
    "quad_coeff",
    "quad_r2",
    "n_jumps",
    "jump_max_mm",
    "n_valid_frac",
    "acf_lag1",
    "cusum_score",
    "velocity_r2",
    "range_mm",
    "noise_p90",
)


def cell_degrees(zoom: int) -> float:
    if zoom < 0:
        return 1e-5
    return CELL_DEGREES[min(zoom, len(CELL_DEGREES) - 1)]
