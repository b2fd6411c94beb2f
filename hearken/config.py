"""Fixed vocabulary of the engine: metrics, feature sets and calibration values."""

from __future__ import annotations

from typing import NamedTuple


class Metric(NamedTuple):
    """One measured distance: which columns carry it and how to orient it."""

    key: str
    mean: str
    var: str
    transform: str
    direction: float
    role: str


# Metric table (columns, stabilising transform, sign, role).
METRICS = (
    Metric("l2", "l2_mean", "l2_var", "log1p", -1.0, "primary"),
    Metric("cosim", "cosim_mean", "cosim_var", "fisher", 1.0, "primary"),
    Metric("kl", "kl_mean", "kl_var", "log1p", -1.0, "auxiliary"),
    Metric("js", "js_mean", "js_var", "log1p", -1.0, "auxiliary"),
)

KEYS = ("name", "subdir", "x")
NUMERIC = ("n_windows",) + tuple(c for m in METRICS for c in (m.mean, m.var))
X_COLUMNS = ("subdir", "name", "x") + NUMERIC

# Feature sets of the per-subdir models.
PRIMARY = ("l2_quality_mean", "l2_quality_median", "cosim_quality_mean", "cosim_quality_median")
STABILITY = ("l2_stability_quality", "cosim_stability_quality", "l2_uncertainty_quality", "cosim_uncertainty_quality")
AUXILIARY = (
    "kl_quality_mean", "kl_quality_median", "js_quality_mean", "js_quality_median",
    "kl_stability_quality", "js_stability_quality",
)

# Calibration of preferences and of the search grids.
PREFERENCE_SLOPE = 0.693
NOTICEABLE_GAP = 2.0
ALLOWED_GAMMAS = (0.0, 0.05, 0.1, 0.2)
SUBDIR_ALPHAS = (1.0, 10.0, 100.0)
AUXILIARY_ALPHA = 100.0
OVERALL_ALPHAS = (0.1, 1.0, 10.0)
RANK_LAMBDAS = (0.25, 1.0, 4.0)
WINDOW_ALPHAS = (0.1, 0.3, 1.0, 3.0, 10.0, 30.0, 100.0, 300.0)
MODEL_FORMAT_VERSION = 2

# Columns of the window-level table and the preferred window-level features.
WINDOW_KEYS = ("name", "subdir", "audio_index")
WINDOW_METRICS = ("kl_mean", "kl_var", "js_mean", "js_var", "l2", "cos_sim")
OPTIONAL_WINDOW_METRICS = ("l2_var", "cos_sim_var")
POOLED = (("kl", "kl_mean", "kl_var"), ("js", "js_mean", "js_var"), ("l2", "l2", "l2_var"), ("cos_sim", "cos_sim", "cos_sim_var"))
RECOMMENDED_FEATURES = (
    "kl_pooled_audio_mean_device_mean", "kl_pooled_audio_var_device_mean", "kl_pooled_audio_mean_between_audio_std",
    "js_pooled_audio_mean_device_mean", "js_pooled_audio_var_device_mean", "js_pooled_audio_mean_between_audio_std",
    "l2_audio_median_device_mean", "l2_audio_median_between_audio_std",
    "cos_sim_audio_median_device_mean", "cos_sim_audio_median_between_audio_std",
)

# A group above this many rows leaves the one-reducer path and goes through
# operators.skew, which spreads a single group over many tasks.
HOT_GROUP_ROWS = 500_000
# Rows per side of one block in blocked pair reductions.
PAIR_BLOCK_ROWS = 1024
