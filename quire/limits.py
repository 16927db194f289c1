"""Caps on what one document may cost. All are counts or sizes, applied in a fixed order."""

MATCHES_PER_PAGE = 1_000
MATCHES_PER_DOCUMENT = 10_000
SNIPPET_REACH = 40
PAGE_TEXT_UNITS = 2_097_152
SELECTION_UNITS = 4_194_304
REGIONS_PER_PAGE = 1_024
HIGHLIGHTS_PER_PAGE = 4_096
GLYPHS_PER_PAGE = 500_000
TILE_KEYS = 256
REFERENCE_HOPS = 32
TREE_DEPTH = 256
PAGES = 1_000_000
NESTING = 512
SECTIONS = 1_024
OUTLINE_ITEMS, OUTLINE_DEPTH = 50_000, 64
DECODED_BYTES = 512 * 1024 * 1024
CONTENT_BYTES = 32 * 1024 * 1024
