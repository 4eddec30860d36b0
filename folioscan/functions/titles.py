"""Page titles, their addresses, and the names of dump files."""

from email.utils import parsedate_to_datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x):
    return F.col(x) if isinstance(x, str) else x


def normalize_title(title) -> Column:
    """Every U+0020 becomes an underscore; nothing else changes. Null stays null."""
    return F.translate(_col(title), " ", "_")


def page_url(title, lang="en") -> Column:
    """``lang`` is a language code or a column of codes."""
    code = F.lit(lang) if isinstance(lang, str) else lang
    return F.concat(F.lit("http://"), code, F.lit(".wikipedia.org/wiki/"), normalize_title(title))


def reversed_url(title, lang="en") -> Column:
    code = F.lit(lang) if isinstance(lang, str) else lang
    return F.concat(F.lit("org.wikipedia."), code, F.lit("/wiki/"), normalize_title(title))


def dump_url(lang: str) -> str:
    """Where the newest articles dump of a language is published."""
    return f"http://dumps.wikimedia.org/{lang}wiki/latest/{lang}wiki-latest-pages-articles.xml.bz2"


def dump_file_name(lang: str, modified_ms: int, suffix: str = ".xml") -> str:
    return f"{lang}wiki-latest-pages-articles.{modified_ms}{suffix}"


def http_date_ms(value: str) -> int:
    """Epoch milliseconds of an HTTP date; raises OSError for anything else."""
    try:
        return int(parsedate_to_datetime(value).timestamp() * 1000)
    except (TypeError, ValueError) as e:
        raise OSError(f"not an HTTP date: {value!r}") from e
