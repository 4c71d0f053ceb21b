"""Labels, keys and text joins, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The label numbers of the data model.
LABELS = {"NUMBER": 1, "DECIMAL": 2, "FRACTION": 3, "INT": 4, "MEASUREMENT": 5, "FEET": 6, "INCHES": 7, "FRACTION_LINE": 8}
UNIT = "(?i)(\"|'|feet|foot|inches|inch?$)"


def normal_key(text: Column) -> Column:
    """Line breaks as spaces, lower case, no white space around."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit("\n"), F.lit(" "))), r"^\s+|\s+$", "")


def _whole(text: Column, pattern: str) -> Column:
    return text.rlike(f"^(?:{pattern})\\z")


def has_decimal(text: Column) -> Column:
    return _whole(text, "[0-9]*\\.[0-9]+")


def has_fraction(text: Column) -> Column:
    return _whole(text, "[0-9]+/[0-9]+")


def has_int(text: Column) -> Column:
    return _whole(text, "[0-9]+")


def unit(text: Column) -> Column:
    """The first unit in a text, lower case; empty if there is none."""
    return F.lower(F.regexp_extract(text, UNIT, 1))


def unit_place(text: Column) -> Column:
    """Where it begins, counted from 0; -1 if there is none."""
    return F.regexp_instr(text, F.lit(UNIT)) - 1


def label_flags(text: Column) -> dict[str, Column]:
    """Probability of each label; 0 where it does not apply.  Numbers are whole texts; units count at the beginning only."""
    number = has_decimal(text) | has_fraction(text) | has_int(text)
    some = F.coalesce(~number & (unit_place(text) == 0), F.lit(False))
    u = unit(text)
    given = lambda c, v: F.when(c, v).otherwise(0.0)
    return {
        "number": given(number, 1.0),
        "decimal": given(has_decimal(text), 1.0),
        "fraction": given(has_fraction(text), 1.0),
        "int": given(has_int(text), 1.0),
        "measurement": given(some, 0.2),
        "feet": given(some & u.isin("feet", "foot", "'"), 0.2),
        "inches": given(some & u.isin("inches", "inch", '"'), 0.2),
    }


def label_map(text: Column, is_line: Column | None = None, slope: Column | None = None) -> Column:
    """map<int, double> of label numbers to probabilities; a slash, or a rising line, may be a fraction's bar."""
    flags = {LABELS[k.upper()]: v for k, v in label_flags(text).items()}
    bar = F.coalesce(text == "/", F.lit(False))
    if is_line is not None:
        bar = bar | (is_line & (slope >= 0) & (slope < 3))
    flags[LABELS["FRACTION_LINE"]] = F.when(bar, 0.1).otherwise(0.0)
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in flags.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"] > 0))


def label(labels: Column, name: str) -> Column:
    """A label's probability, 0 if it is absent."""
    return F.coalesce(F.element_at(labels, LABELS[name]), F.lit(0.0))


def label_pattern(row_id: Column, wildcard: bool = False) -> Column:
    """Regular expression for the labels of a schedule row; with wildcard, ## stands for one or two digits."""
    body = F.replace(row_id, F.lit("##"), F.lit("\\d\\d?")) if wildcard else row_id
    return F.concat(F.lit("^("), body, F.lit(")[\\n ]?$"))


def is_literal(row_id: Column) -> Column:
    """An id without a character that regular expressions give a meaning."""
    return ~row_id.rlike(r"[\\.^$|?*+()\[\]{}#]")


def label_body(text: Column) -> Column:
    """A label without one line break or space at its end."""
    return F.regexp_replace(text, "[\\n ]\\z", "")


def is_window_key(text: Column) -> Column:
    """A letter and two digits."""
    return _whole(text, "[A-Za-z][0-9]{2}")


def is_page_name(text: Column, captions: tuple[str, ...] = ("sheet no.", "sheet title")) -> Column:
    """Neither a sheet's key nor one of the captions."""
    return ~_whole(text, "[a-zA-Z]-[0-9][0-9]?") & ~normal_key(text).isin(*captions)


def is_multiline(text: Column) -> Column:
    return F.instr(text, "\n") > 0


def letter_code(c: Column) -> Column:
    """1-26 for a-z, 27-36 for 0-9, 38 line break, 39 !, 40 /, else 0."""
    at = F.instr(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), c)
    return F.when(F.length(c) == 1, F.when(at > 0, at).when(c == "\n", 38).when(c == "!", 39).when(c == "/", 40).otherwise(0)).otherwise(0)


def text_code(text: Column) -> Column:
    """Sum of letter codes times powers of ten by position."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(F.transform(letters, lambda c, i: letter_code(c) * F.pow(F.lit(10.0), i)), F.lit(0.0), lambda s, v: s + v)


def bounds_text(sides: list[Column]) -> Column:
    """(a,b,c,d) with two decimals; -1 for an open side."""
    shown = [F.when(s.isNull(), "-1").otherwise(F.format_string("%.2f", s)) for s in sides]
    return F.concat(F.lit("("), F.concat_ws(",", *shown), F.lit(")"))


def joined_text(nodes: Column) -> Column:
    """Text of an ordered array of struct(text, is_line, slope, length): a short bar between texts reads "/".

    No slash follows a slash or a space; a quote drops the slash before it; nodes without any text give "".  No space is put
    into wide gaps.
    """

    def step(out: Column, n: Column) -> Column:
        bar = n["is_line"] & (n["slope"] >= 0) & (n["slope"] < 3) & (n["length"] < 50)
        open_end = (F.length(out) > 0) & ~F.substring(out, -1, 1).isin("/", " ")
        with_text = F.when((n["text"] == '"') & (F.substring(out, -1, 1) == "/"), F.concat(F.substring(out, 1, F.length(out) - 1), n["text"])).otherwise(F.concat(out, n["text"]))
        return F.when(n["text"].isNotNull(), with_text).when(bar & open_end, F.concat(out, F.lit("/"))).otherwise(out)

    return F.when(F.exists(nodes, lambda n: n["text"].isNotNull()), F.aggregate(nodes, F.lit(""), step)).otherwise("")


def joined_cells(items: Column) -> Column:
    """Text of an ordered array of struct(text): anything without text between texts reads "/"."""
    return F.aggregate(items, F.lit(""), lambda out, n: F.when(n["text"].isNotNull(), F.concat(out, n["text"])).when((F.length(out) > 0) & (F.substring(out, -1, 1) != "/"), F.concat(out, F.lit("/"))).otherwise(out))


#: What a measure is made of, and how its units read.
MEASURE = "[0-9]+/[0-9]+|[0-9]*\\.[0-9]+|[0-9]+|'|\"|feet|foot|ft|inches|inch|in"
FEET, INCHES = ("'", "feet", "foot", "ft"), ('"', "inches", "inch", "in")


def feet(text: Column) -> Column:
    """A measure such as 12' 6 1/2" in feet: numbers and fractions add up until a unit takes them; without one they are feet.

    Null for a text without a number.
    """
    tokens = F.regexp_extract_all(F.lower(text), F.lit(MEASURE), F.lit(0))
    start = F.struct(F.lit(0.0).alias("total"), F.lit(0.0).alias("open"))

    def step(s: Column, t: Column) -> Column:
        part = F.split(t, "/")
        value = F.when(F.size(part) == 2, F.try_divide(part[0].try_cast("double"), part[1].try_cast("double"))).otherwise(t.try_cast("double"))
        total = F.when(t.isin(*FEET), s["total"] + s["open"]).when(t.isin(*INCHES), s["total"] + s["open"] / 12).otherwise(s["total"])
        return F.struct(total.alias("total"), F.when(t.isin(*FEET, *INCHES), 0.0).otherwise(s["open"] + F.coalesce(value, F.lit(0.0))).alias("open"))

    return F.when(F.exists(tokens, lambda t: t.rlike("[0-9]")), F.aggregate(tokens, start, step, lambda s: s["total"] + s["open"]))


def measures(text: Column) -> Column:
    """array of the measures of a text such as 12' x 9', in feet."""
    return F.filter(F.transform(F.split(F.lower(text), "x|by"), feet), lambda v: v.isNotNull())
