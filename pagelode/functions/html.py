"""Text out of HTML by patterns, Column in and Column out.

The text functions take markup that went through ``element_markup``. Tags, attributes and class
tokens are matched as an HTML reader sees them: quotes of either kind or none, ``>`` inside a
quoted value, tag names in either case. Repeated groups are possessive, so a long attribute list
cannot exhaust the stack of the regex engine.
"""

import json
import re
from html.entities import html5, name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelode.functions.binding import let
from pagelode.functions.text import collapse_spaces, strip

_QUOTED = r"""[^"'>]++|"[^"]*+"|'[^']*+'"""
_ANY_TAG = rf"<(?=[A-Za-z/!?])(?:{_QUOTED})*+>"
_NO_MARKUP = "<!>"  # stands where a comment, script or style sheet was
_CUT = "\uffff"  # no character; removed from pages, so it marks where a text is cut
# The ampersand comes last, so that what it uncovers is not decoded again.
MARKUP_REFERENCES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&amp;": "&"}
_ALL = 1 << 30  # more than any page has; the largest integer would overflow in slice


def _up_to_attribute(name: str) -> str:
    """Pattern for the part of a tag in front of the value of one attribute."""
    skip = rf"""\s++(?!(?i:{name})\s*=)|[^ \t\n\f\r"'>]++|"[^"]*+"|'[^']*+'"""
    return rf"(?:{skip})*+\s++(?i:{name})\s*=\s*"


def opening(tag: str, *, cls: str | None = None, classes: str | None = None,
            id: str | None = None) -> str:
    """Pattern for an opening tag.

    ``cls`` asks for one class among others, ``classes`` for exactly this class list and ``id``
    for exactly this id.
    """
    return _open_tag(tag, cls=cls, classes=classes, id=id) + ">"


def _open_tag(tag: str, *, cls: str | None = None, classes: str | None = None,
              id: str | None = None) -> str:
    """Pattern for an opening tag without its closing bracket."""
    head = rf"<(?i:{tag})(?=[\s/>])"
    if cls is not None:
        word = re.escape(cls)
        head += (_up_to_attribute("class")
                 + rf"""(?:"(?:[^"]*\s)?{word}(?:\s[^"]*)?"|'(?:[^']*\s)?{word}(?:\s[^']*)?'"""
                 + rf"""|{word}(?=[\s>]))""")
    elif classes is not None:
        words = r"\s+".join(re.escape(c) for c in classes.split())
        head += (_up_to_attribute("class")
                 + rf"""(?:"\s*{words}\s*"|'\s*{words}\s*')""")
    elif id is not None:
        word = re.escape(id)
        head += (_up_to_attribute("id")
                 + rf"""(?:"{word}"|'{word}'|{word}(?=[\s>]))""")
    return head + rf"(?:{_QUOTED})*+"


def _closing(tag: str) -> str:
    return rf"(?:</(?i:{tag})\s*>|\z)"


def _up_to(tag: str) -> str:
    """Pattern for everything in front of the next closing tag of this name."""
    return rf"(?:[^<]++|<(?!/(?i:{tag})[\s>]))*+"


def _without(tag: str) -> str:
    """Pattern for content that neither opens nor closes an element of this name."""
    return rf"(?:[^<]++|<(?!/?(?i:{tag})[\s/>]))*+"


def _balanced(tag: str, depth: int = 4) -> str:
    """Pattern for content in which elements of this name are closed, to a depth of nesting."""
    pattern = _without(tag)
    for _ in range(depth):
        pattern = (rf"(?:[^<]++|<(?!/?(?i:{tag})[\s/>])"
                   rf"|{_open_tag(tag)}>{pattern}</(?i:{tag})\s*>)*+")
    return pattern


def element_markup(html: Column) -> Column:
    """The page without comments, scripts and style sheets, whose text is no markup.

    Character references are decoded on the way, but for those that stand for characters of the
    markup itself; the text functions do these.
    """
    bare = F.regexp_replace(
        F.replace(html, F.lit(_CUT), F.lit("")),
        F.lit(r"(?is)<(?:!--.*?-->|script\b.*?</script\s*>|style\b.*?</style\s*>)"),
        F.lit(_NO_MARKUP))
    return let(bare, decode_references)


def cut_at(text: Column, pattern: str) -> Column:
    """Split at a pattern.

    ``split`` would compile its pattern anew for every value; ``regexp_replace`` keeps it, and a
    split at one plain character needs none.
    """
    return F.split(F.regexp_replace(text, F.lit(pattern), F.lit(_CUT)), F.lit(_CUT))


def pieces_after(markup: Column, pattern: str) -> Column:
    """For every match of an opening tag the text that follows it, up to the next match."""
    return F.slice(cut_at(markup, pattern), F.lit(2), F.lit(_ALL))


def up_to_close(rest: Column, tag: str) -> Column:
    """Content of an element, given the text after its opening tag.

    Elements of the same name inside it are skipped; an element that is never closed reaches to
    the end of the text.
    """
    nested = F.lit(rf"<(?i:{tag})(?=[\s/>])")

    def joined(parts: Column) -> Column:
        def step(state: Column, part: Column) -> Column:
            depth = state["depth"] + F.regexp_count(part, nested) - F.lit(1)
            return F.when(state["depth"] == 0, state).otherwise(
                F.struct(depth.alias("depth"), (state["n"] + F.lit(1)).alias("n")))

        start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("n"))
        count = F.aggregate(parts, start, step)["n"]
        return F.array_join(F.slice(parts, F.lit(1), count), f"</{tag}>")

    return let(cut_at(rest, rf"(?i)</{tag}\s*>"), joined)


def first_element(markup: Column, tag: str, **match: str) -> Column:
    """The first matching element with its tags; null where there is none.

    One pattern takes an element whose content closes what it opens; what that leaves unclosed, by
    deep nesting or bad markup, is worked out by counting tags.
    """
    start = _open_tag(tag, **match)
    usual = F.regexp_extract(markup, rf"({start}>{_balanced(tag)}(?:</(?i:{tag})>)?)", 1)
    return let(usual, lambda found: F.when(found == "", None)
               .when(F.endswith(found, F.lit(f"</{tag}>")), found)
               .otherwise(F.concat(F.lit(f"<{tag}>"), up_to_close(
                   F.regexp_extract(markup, rf"(?s){start}>(.*)", 1), tag))))


def elements(markup: Column, tag: str, **match: str) -> Column:
    """Contents of all matching elements, in document order."""
    def content(piece: Column) -> Column:
        usual = F.regexp_extract(piece, rf"^({_balanced(tag)}(?:</(?i:{tag})>)?)", 1)
        return let(usual, lambda found: F.when(
            F.endswith(found, F.lit(f"</{tag}>")), found).otherwise(up_to_close(piece, tag)))

    return F.transform(pieces_after(markup, opening(tag, **match)), content)


def text_before_close(piece: Column, tag: str) -> Column:
    """Text in front of the first closing tag, for elements that cannot hold one another."""
    return F.regexp_extract(piece, rf"^({_up_to(tag)})", 1)


def table_rows(table: Column) -> Column:
    """Contents of the rows of a table.

    A row that is not closed before the next one begins belongs to neither and is left out.
    """
    return F.regexp_extract_all(
        table, F.lit(rf"{opening('tr')}({_without('tr')}){_closing('tr')}"), F.lit(1))


def row_cells(row: Column) -> Column:
    """Contents of the cells of a row."""
    return F.regexp_extract_all(
        row, F.lit(rf"{opening('td')}({_without('td')}){_closing('td')}"), F.lit(1))


def attribute(tag_text: Column, name: str) -> Column:
    """Decoded value of an attribute, given the text of a tag after its name; null if absent."""
    raw = F.regexp_extract(
        tag_text,
        rf"""^{_up_to_attribute(name)}("[^"]*+"|'[^']*+'|[^ \t\n\f\r"'>]++)""", 1)
    return let(raw, lambda r: F.when(
        r != "", decode_markup_references(F.regexp_replace(r, F.lit(r"""(?s)^(["'])(.*)\1$"""), F.lit("$2")))))


def tag_and_content(piece: Column) -> tuple[Column, Column]:
    """Split the text after a tag name into the attributes and what follows the tag."""
    tag = F.regexp_extract(piece, rf"^((?:{_QUOTED})*+)>", 1)
    return tag, F.substr(piece, F.char_length(tag) + F.lit(2))


def decode_references(text: Column) -> Column:
    """Replace character references: the named ones of HTML 5, and all numeric ones.

    They are read as HTML readers do: the older names also without a semicolon and at the start of a
    longer word, 128 to 159 as Windows-1252, and numbers that are no character as U+FFFD. Those of the
    five markup characters come out under their names, to be decoded last.
    """
    common = F.from_json(F.lit(_reference_table(HTML4_NAMES)), "map<string,string>")
    names = F.from_json(F.lit(_reference_table(html5)), "map<string,string>")
    windows = F.from_json(F.lit(_windows_table()), "map<string,string>")

    def kept(c: Column) -> Column:
        return F.coalesce(*[F.when(c == char, name) for name, char in MARKUP_REFERENCES.items()], c)

    def char(code: Column) -> Column:
        """``code``: hexadecimal digits without leading zeros."""
        number = F.conv(code, 16, 10).cast("bigint")
        good = (F.char_length(code) <= 6) & (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        return (F.when(number.between(128, 159), F.coalesce(F.try_element_at(windows, number.cast("string")), F.lit("\ufffd")))
                .when(good, let(F.decode(F.unhex(F.lpad(code, 8, "0")), "UTF-32"), kept)).otherwise("\ufffd"))

    def decimal(digits: Column) -> Column:
        return F.when(F.char_length(digits) <= 7, char(F.hex(digits.cast("bigint")))).otherwise("\ufffd")

    def named(t: Column) -> Column:
        old = F.regexp_extract(t, _old_names(), 1)
        longest = F.when(old != "", F.concat(F.try_element_at(names, F.concat(old, F.lit(";"))),
                                             F.substr(t, F.char_length(old) + F.lit(1))))
        return F.coalesce(F.try_element_at(common, t), F.try_element_at(names, t), longest, t)

    def token(t: Column) -> Column:
        return (
            F.when(t.rlike("^&#[0-9]"), let(F.regexp_extract(t, "^&#0*+([0-9]*+)", 1), lambda d: decimal(
                F.when(d == "", "0").otherwise(d))))
            .when(t.rlike("^&#[xX][0-9A-Fa-f]"), let(F.regexp_extract(t, "^&#.0*+([0-9A-Fa-f]*+)", 1), lambda d: char(
                F.when(d == "", "0").otherwise(d))))
            .when(t.rlike("^&[A-Za-z]"), named(t))
            .otherwise(t))

    tokens = F.regexp_extract_all(
        text, F.lit(r"(&#[0-9]++;?|&#[xX][0-9A-Fa-f]++;?|&[A-Za-z][A-Za-z0-9]*+;?|[^&]++|&)"), F.lit(1))
    return F.when(text.rlike(r"&(?!(?:amp|lt|gt|quot|apos);)[#A-Za-z]"),
                  F.array_join(F.transform(tokens, token), "")).otherwise(text)


def decode_markup_references(text: Column) -> Column:
    """Replace the references of the five markup characters."""
    decoded = text
    for name, char in MARKUP_REFERENCES.items():
        decoded = F.replace(decoded, F.lit(name), F.lit(char))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def decode_entities(text: Column) -> Column:
    """Replace all character references of a text without tags."""
    return let(decode_references(text), decode_markup_references)


# The names of HTML 4 are tried first, as a lookup goes through its table.
HTML4_NAMES = {f"{name};": chr(code) for name, code in name2codepoint.items()}


def _reference_table(characters: dict[str, str]) -> str:
    """References with their semicolon; those of the markup characters give its usual name."""
    markup = {char: name for name, char in MARKUP_REFERENCES.items()}
    return json.dumps({f"&{name}": markup.get(char, char) for name, char in characters.items() if name.endswith(";")})


def _windows_table() -> str:
    """What the numbers 128 to 159 stand for, where Windows-1252 has a character."""
    return json.dumps({str(i): bytes([i]).decode("cp1252", "ignore") or "\ufffd" for i in range(128, 160)})


def _old_names() -> str:
    """A pattern of the names that need no semicolon, the longest ones first."""
    names = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
    return f"^(&(?:{'|'.join(names)}))"


def spaced_text(markup: Column) -> Column:
    """Text with a space where a tag was; drawings (svg) left out, whitespace collapsed."""
    drawing = r"(?s)<(?i:svg)\b.*?</(?i:svg)\s*>"
    bare = F.when(F.contains(markup, F.lit("<")),
                  F.regexp_replace(markup, F.lit(f"{drawing}|{_ANY_TAG}"), F.lit(" "))
                  ).otherwise(markup)
    return collapse_spaces(let(bare, decode_markup_references))


def tight_text(markup: Column) -> Column:
    """Text whose pieces between tags are stripped and joined with nothing."""
    bare = F.when(
        F.contains(markup, F.lit("<")),
        F.array_join(F.transform(cut_at(markup, _ANY_TAG), strip), "")).otherwise(markup)
    return strip(let(bare, decode_markup_references))


def element_text_or_default(markup: Column, tag: str, default: str = "Unknown",
                            **match: str) -> Column:
    """text of the first matching element, the default where it is missing or empty."""
    return let(tight_text(first_element(markup, tag, **match)),
               lambda t: F.coalesce(F.when(t != "", t), F.lit(default)))


def element_attribute_or_default(markup: Column, tag: str, name: str, default: str = "Unknown",
                                 **match: str) -> Column:
    """an attribute of the first matching element, the default where it is missing."""
    found = F.regexp_extract(markup, f"({opening(tag, **match)})", 1)
    return F.coalesce(attribute(F.substr(found, F.lit(len(tag) + 2)), name), F.lit(default))
