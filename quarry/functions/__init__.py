from quarry.functions.text import (  # noqa: F401
    WS_CLASS, file_name, file_suffix, header_count, iso_timestamp, line_count,
    normalize_newlines, preview, round_half_even, word_count,
)
