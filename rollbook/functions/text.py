"""Text and JSON column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: joins several values that share one cell.
SEPARATOR = " | "

# Whitespace as Unicode defines it plus the four ASCII separators.
_SPACE = r"[\s\x1c-\x1f]"
# The same, one by one.
_SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
# Commas and colons outside string literals of a compact JSON text.
_JSON_PUNCTUATION = r'\G((?:"(?:[^"\\]++|\\.)*+"|[^",:"]++)*+)([,:])'


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column) -> Column:
    """Trim every kind of Unicode whitespace, not only spaces."""
    return F.btrim(value, F.lit(_SPACES))


def squash(value: Column) -> Column:
    """Collapse runs of whitespace to one space and trim."""
    return strip(F.regexp_replace(value, rf"(?U){_SPACE}+", " "))


def shorten(value: Column, width: int) -> Column:
    """Whitespace-collapsed text of at most ``width`` characters, ``…`` where cut."""
    text = squash(value)
    return F.when(F.length(text) <= width, text).otherwise(
        F.concat(F.substring(text, 1, width - 1), F.lit("…"))
    )


def fold(value: Column) -> Column:
    """Case folding: lower case, with ß, long s and final sigma unified.

    Accents stay significant.
    """
    text = F.lower(value)
    for letter, plain in (("ß", "ss"), ("ς", "σ"), ("ſ", "s")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return text


def blank_to_null(value: Column) -> Column:
    return F.when(value != "", value)


def literal_pattern(text: str) -> str:
    """A Java regular expression that matches ``text`` itself."""
    return r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def split_literal(value: Column, separator: str) -> Column:
    return F.split(value, literal_pattern(separator))


_JSON_STRING = r'"(?:[^"\\]++|\\.)*+"'


def spaced_json(compact: Column) -> Column:
    """Add one blank after each comma and colon that is not inside a string."""
    return F.regexp_replace(compact, _JSON_PUNCTUATION, "$1$2 ")


def variant_json(value: Column) -> Column:
    """A VARIANT as JSON text with sorted keys."""
    return spaced_json(F.to_json(value))


def sorted_map_json(fields: Column, *, filled: bool = False) -> Column:
    """A string map as JSON text with sorted keys; equal maps give equal text.  ``filled`` gives null values as blank ones."""
    entries = F.to_json(F.sort_array(F.map_entries(fields)), {"ignoreNullFields": "false"})
    # Without escapes, all quotes are those around names and values; what stands between two entries, or between a
    # key and its value, then cannot stand inside one.  A pattern over the whole text takes several times as long.
    plain = ~F.contains(entries, F.lit("\\")) & ~F.contains(entries, F.lit('"value":null')) & (entries != "[]")
    text = entries
    for old, new in (('[{"key":"', '{"'), ('","value":"', '": "'), ('"},{"key":"', '", "')):
        text = F.replace(text, F.lit(old), F.lit(new))
    rest = F.transform_values(fields, lambda _, v: F.coalesce(v, F.lit(""))) if filled else fields
    whole = spaced_json(F.to_json(F.map_from_entries(F.sort_array(F.map_entries(rest)))))
    return F.when(plain, F.rtrim(text, F.lit("]"))).otherwise(whole)


def let(value: Column, body) -> Column:
    """``body`` applied to ``value``, which is evaluated once.

    A column expression used inside a lambda is otherwise evaluated again for
    every element the lambda sees.
    """
    return F.transform(F.array(value), body)[0]


def list_of(value: Column) -> Column:
    """A JSON list as an array, NULL for anything else."""
    return F.try_variant_get(value, "$", "array<variant>")


def members(value: Column) -> Column:
    """A JSON object as a map, NULL for anything else."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def is_list(value: Column) -> Column:
    return list_of(value).isNotNull()


def is_object(value: Column) -> Column:
    return members(value).isNotNull()


def is_json_null(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _plain(value: Column) -> Column:
    """A JSON value as text, objects and lists spaced."""

    def spaced(text: Column) -> Column:
        # The cheap look at the first character spares most values the type test.
        nested = (F.startswith(text, F.lit("{")) & is_object(value)) | (F.startswith(text, F.lit("[")) & is_list(value))
        return F.when(text.isNull(), "").when(nested, spaced_json(text)).otherwise(text)

    return let(value.cast("string"), spaced)


def _list_depth(text: Column) -> Column:
    """How deep the brackets of a JSON text nest; strings do not count."""
    brackets = F.regexp_extract_all(F.regexp_replace(text, _JSON_STRING, ""), F.lit(r"[\[\]]"), F.lit(0))

    def step(state: Column, bracket: Column) -> Column:
        at = state["at"] + F.when(bracket == "[", 1).otherwise(-1)
        return F.struct(at.alias("at"), F.greatest(state["most"], at).alias("most"))

    return F.aggregate(brackets, F.struct(F.lit(0).alias("at"), F.lit(0).alias("most")), step, lambda state: state["most"])


def _open_lists(items: Column) -> Column:
    """``items`` with the members of its lists in their place; an empty list becomes an empty string."""
    empty = F.array(F.parse_json(F.lit('""')))

    def opened(item: Column) -> Column:
        return let(list_of(item), lambda own: F.when(own.isNull(), F.array(item)).when(F.size(own) == 0, empty).otherwise(own))

    return F.flatten(F.transform(items, opened))


def variant_cell(value: Column, separator: str = SEPARATOR, *, skip_blank: bool = False, depth: int | None = None) -> Column:
    """Render one JSON value as one cell.

    Null becomes the empty string, a list its joined members (nested lists are
    joined too, however deep), an object sorted JSON.  ``skip_blank`` leaves null and empty
    members of a list out.  With a ``depth`` of one, inner lists stay JSON.
    """

    def members_of(item: Column) -> Column:
        if depth == 1:
            return list_of(item)
        text = item.cast("string")
        # Lists are opened as often as the text itself says; the pattern spares most values the count.
        rounds = F.when(text.rlike(r"(?s)^\[.*\["), _list_depth(text) - 1).otherwise(0)
        return F.aggregate(F.array_repeat(F.lit(0), rounds), list_of(item), lambda items, _: _open_lists(items))

    if depth not in (None, 1):
        raise ValueError("depth is one or unbounded")
    cells = F.transform(members_of(value), _plain)
    if skip_blank:
        cells = F.filter(cells, lambda v: v != "")
    # Only a text that begins like a list can be one; others are spared the type test.
    listed = F.startswith(value.cast("string"), F.lit("["))
    return F.when(listed, F.coalesce(F.array_join(cells, separator), _plain(value))).otherwise(_plain(value))


def merge_maps(left: Column, right: Column) -> Column:
    """``map_concat`` in which the right side wins for keys present in both."""

    def merged(whole: Column, r: Column) -> Column:
        rest = F.map_filter(whole, lambda k, _: ~F.map_contains_key(r, k))
        # Most sides share no key; the lambda is spared then.
        return F.map_concat(F.when(F.arrays_overlap(F.map_keys(whole), F.map_keys(r)), rest).otherwise(whole), r)

    return let(right, lambda r: let(left, lambda whole: merged(whole, r)))
