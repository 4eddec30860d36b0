from folioscan.operators.index import ArticleNotFound, lookup_id, lookup_title, open_index, write_index
from folioscan.operators.revisions import count_redirects, redirect_counters, skip_redirects, sort_by_id, with_position

__all__ = ["ArticleNotFound", "count_redirects", "lookup_id", "lookup_title", "open_index", "redirect_counters", "skip_redirects", "sort_by_id", "with_position", "write_index"]
