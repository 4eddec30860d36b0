from folioscan.sources.catalog import Fetcher, HttpFetcher, newest_local, resolve_dump
from folioscan.sources.dump import pages_of, read_dump, revisions_of

__all__ = ["Fetcher", "HttpFetcher", "newest_local", "pages_of", "read_dump", "resolve_dump", "revisions_of"]
