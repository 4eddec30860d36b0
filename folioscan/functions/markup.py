"""XML entities and wikitext, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The named entities of XML.
XML_ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}

_PIECE = r"(?s)&(?:lt|gt|quot|apos|amp|#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6});|&|[^&]+"


def _named(c: Column) -> Column:
    """One pass in effect: the ampersand is decoded last, so no result is read again."""
    for name, char in XML_ENTITIES.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c


def _one(piece: Column) -> Column:
    digits = F.regexp_extract(piece, r"^&#(?:[xX]([0-9a-fA-F]+)|[0-9]+);$", 1)
    decimal = F.regexp_extract(piece, r"^&#([0-9]+);$", 1)
    code = F.when(digits != "", F.conv(digits, 16, 10).cast("long")).when(decimal != "", decimal.cast("long"))
    valid = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).when(piece.startswith("&"), _named(piece)).otherwise(piece)


def unescape_xml(text) -> Column:
    """Decode lt, gt, quot, apos, amp and numeric references in a single pass.

    References to no valid code point stay as they are. Only texts that hold a
    numeric reference take the longer way over their pieces. Null stays null.
    """
    c = F.col(text) if isinstance(text, str) else text
    pieces = F.regexp_extract_all(c, F.lit(_PIECE), F.lit(0))
    return F.when(c.contains("&#"), F.array_join(F.transform(pieces, _one), "")).otherwise(_named(c))


# Namespaces and closing sections that plain text leaves out, by language.
MEDIA = {
    "en": ["File", "Image", "Category"],
    "de": ["Datei", "Bild", "Kategorie", "File", "Image", "Category"],
    "zh": ["文件", "图像", "檔案", "圖像", "分类", "分類", "File", "Image", "Category"],
}
FOOTERS = {
    "en": ["See also", "References", "External links", "Further reading", "Notes"],
    "de": ["Siehe auch", "Einzelnachweise", "Weblinks", "Literatur", "Anmerkungen"],
    "zh": ["参见", "參見", "参考文献", "參考文獻", "外部链接", "外部連結", "注释", "註釋"],
}
# Elements whose contents are no prose.
DROPPED = ["gallery", "math", "timeline", "score", "syntaxhighlight", "source"]


def _without_nested(c: Column, opens: str, closes: str) -> Column:
    """Less all that stands between matching marks, at any depth; marks without a partner stay.

    Texts are cut at the marks. One fold over the parts keeps what is still to be
    put out and where in it the open marks are; a closing mark takes away everything
    from its partner on. Only texts that hold both marks take that way.
    """
    cut = "\0"  # no character of XML
    marked = F.replace(F.replace(c, F.lit(opens), F.lit(cut + opens + cut)), F.lit(closes), F.lit(cut + closes + cut))
    empty = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<int>").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        out, at = acc["out"], acc["open"]
        grown = F.concat(out, F.array(part))
        opened = F.struct(grown.alias("out"), F.concat(at, F.array(F.size(out))).alias("open"))
        closed = F.struct(F.slice(out, F.lit(1), F.element_at(at, -1)).alias("out"), F.slice(at, F.lit(1), F.size(at) - 1).alias("open"))
        return F.when(part == opens, opened).when((part == closes) & (F.size(at) > 0), closed).otherwise(F.struct(grown.alias("out"), at.alias("open")))

    folded = F.aggregate(F.split(marked, cut), empty, step, lambda acc: F.array_join(acc["out"], ""))
    return F.when(c.contains(opens) & c.contains(closes), folded).otherwise(c)


def _comments(c: Column) -> Column:
    for pattern in (r"(?s)<!--.*?-->", r"(?is)<ref[^<>]*/>", r"(?is)<ref[^<>]*>.*?</ref>", rf"(?is)<({'|'.join(DROPPED)})(?:\s[^<>]*)?>.*?</\1\s*>"):
        c = F.regexp_replace(c, pattern, "")
    return c


def _links(c: Column, lang: str) -> Column:
    """Media, categories, other languages and closing sections go; other links become their labels."""
    media, footers = "|".join(MEDIA[lang]), "|".join(FOOTERS[lang])
    for pattern, to in (
        (rf"\[\[(?:{media}):[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]", ""),
        (r"\[\[[a-z]{2,3}(?:-[a-z]+)*:[^\[\]]*\]\]", ""),
        (rf"(?s)(?:^|\n)==+[ \t]*(?:{footers})[ \t]*==+[ \t]*(?:\n.*)?$", ""),
        (r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", "$1"),
        (r"\[(?:https?|ftp)://[^ \n\]]+[ ]+([^\]\n]*)\]", "$1"),
        (r"\[(?:https?|ftp)://[^ \n\]]+\]", ""),
    ):
        c = F.regexp_replace(c, pattern, to)
    return c


def _marks(c: Column) -> Column:
    """Emphasis, headings, tags and entities; then blank lines and the ends."""
    for pattern, to in ((r"'''''|'''|''", ""), (r"(?m)^=+[ \t]*(.*?)[ \t]*=+[ \t]*$", "$1"), (r"</?[A-Za-z][^<>]*>", "")):
        c = F.regexp_replace(c, pattern, to)
    for name, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("amp", "&")):
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")


def plain_text(text, lang: str = "en") -> Column:
    """Wikitext to prose: no comments, references, templates, tables, galleries, formulas, media, links to other languages or closing sections.

    Templates and tables go at any depth. Links become their labels, marks of
    headings and emphasis go, the result is trimmed. Languages other than de and
    zh follow en. Null stays null.
    """
    c = F.col(text) if isinstance(text, str) else text
    c = F.regexp_replace(_comments(c), r"\{\{\{[^{}]*\}\}\}", "")  # a template's own parameters
    c = _without_nested(_without_nested(c, "{{", "}}"), "{|", "|}")
    return _marks(_links(c, lang if lang in MEDIA else "en"))
