"""Patterns for channels through which an answer could carry data out."""

from gatehouse.functions.text import SPACE

# An image loaded from outside, and URLs that carry a query string.
REMOTE_IMAGE = f"!\\[[^\\]]*\\]\\([{SPACE}]*https?://[^)]*\\)"
LINK_WITH_QUERY = f"\\[[^\\]]*\\]\\([{SPACE}]*https?://[^)?]*\\?[^)]*\\)"
URL_WITH_QUERY = f"https?://[^{SPACE})\\]]+\\?[^{SPACE})\\]]+"
