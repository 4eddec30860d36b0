from folioscan.functions.debug import contributor_text, page_text, revision_text
from folioscan.functions.markup import plain_text, unescape_xml
from folioscan.functions.titles import dump_file_name, dump_url, http_date_ms, normalize_title, page_url, reversed_url

__all__ = ["contributor_text", "dump_file_name", "dump_url", "http_date_ms", "normalize_title", "page_text", "page_url", "plain_text", "reversed_url", "revision_text", "unescape_xml"]
