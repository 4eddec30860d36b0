"""Revisions as text for logs."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The debug text of each record; absent values read "null".
PAGE_TEXT = "title:%s\nid:%d\nisRedirect:%s"
CONTRIBUTOR_TEXT = "username:%s\nid:%d"
REVISION_TEXT = "id:%d\n timestamp:%d\n page: %s \n contributor:%s \n comment:%s \n isMinor:%s \n text:%s"


def page_text(page: str = "page") -> Column:
    return F.when(F.col(page).isNotNull(), F.format_string(PAGE_TEXT, f"{page}.title", f"{page}.id", F.col(f"{page}.is_redirect").cast("string")))


def contributor_text(contributor: str = "contributor") -> Column:
    return F.when(F.col(contributor).isNotNull(), F.format_string(CONTRIBUTOR_TEXT, f"{contributor}.username", f"{contributor}.id"))


def revision_text() -> Column:
    """Over the columns of a revision."""
    return F.format_string(REVISION_TEXT, "id", "timestamp_ms", page_text(), contributor_text(), "comment", F.col("is_minor").cast("string"), "text")
