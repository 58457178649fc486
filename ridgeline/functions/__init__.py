from ridgeline.functions.scalar import (  # noqa: F401
    clamped_probability,
    dot,
    logistic_probability,
    recode,
    slice_array,
    soft_threshold,
    standardize,
    working_response,
    working_weight,
)
