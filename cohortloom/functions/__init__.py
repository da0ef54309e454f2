from .portable import (  # noqa: F401
    draw_index,
    hash48,
    is_zero,
    literal_rows,
    normal_cdf,
    normal_pdf,
    round6,
    round9,
    sigmoid,
    unit_hash,
)
