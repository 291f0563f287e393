"""Column -> Column helpers.

Everything here is a plain Catalyst expression so it stays inside whole-stage
codegen; nothing is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour.
# ---------------------------------------------------------------------------
# Role aliases applied after trim/lower and '-'/' ' -> '_' (staff role counts).
ROLE_ALIASES = {
    "staff": "shelfer",
    "shelf_staff": "shelfer",
    "shelf": "shelfer",
    "godown": "godown_incharge",
    "data_entry_operator": "deo",
    "product_assistance": "product_manager",
    "product_assistant": "product_manager",
    "productmanager": "product_manager",
    "purchase_accounts": "purchase_incharge",
    "purchase_account": "purchase_incharge",
}
# Answer keys read in this order when classifying a confirmation.
CONFIRMATION_KEYS = ("confirmed", "verified", "matches_record", "received", "completed")
CONFIRMATION_YES = ("yes", "true", "confirmed", "verified", "received", "complete")
CONFIRMATION_NO = ("no", "false", "rejected", "mismatch", "missing")
# ---------------------------------------------------------------------------


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_name(col: Column | str) -> Column:
    """lower-case and drop everything outside [a-z0-9]."""
    return F.regexp_replace(F.lower(_c(col)), "[^a-z0-9]", "")


# ISO 8601 shapes: the usual one, which casts as it is, and everything else that is accepted.
_ISO_PLAIN = r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?([+-][0-9]{2}:[0-9]{2})?)?$"
_ISO_ANY = (
    r"^(?!0000)([0-9]{4})(?:-([0-9]{2})-([0-9]{2})|([0-9]{2})([0-9]{2})|-W([0-9]{2})(?:-([0-9]))?|W([0-9]{2})([0-9])?)"
    r"(?:.([0-9]{2})(?::([0-9]{2})(?::([0-9]{2})(?:[.,]([0-9]+))?)?|([0-9]{2})(?:([0-9]{2})(?:[.,]([0-9]+))?)?)?"
    r"(?:([+-])([0-9]{2})(?::?([0-9]{2})(?::?([0-9]{2})(?:\.[0-9]+)?)?)?)?)?$"
)


# The timestamp of an ISO text ``t`` in any of the rarer shapes, from the groups ``g`` of _ISO_ANY, as SQL: a
# Column of this size would be built call by call for every use.
_WEEK, _FOURTH = "cast(coalesce(g[5], g[7]) AS int)", "make_date(cast(g[0] AS int), 1, 4)"  # the fourth is always in week 1
_WEEKDAY = "coalesce(cast(coalesce(g[6], g[8]) AS int), 1)"
_BY_WEEK = f"date_add(date_add({_FOURTH}, -weekday({_FOURTH})), 7 * ({_WEEK} - 1) + {_WEEKDAY} - 1)"
_DATE = (f"CASE WHEN {_WEEK} IS NOT NULL THEN CASE WHEN {_WEEKDAY} BETWEEN 1 AND 7 AND weekofyear({_BY_WEEK}) = {_WEEK} "
         f"THEN date_format({_BY_WEEK}, 'yyyy-MM-dd') END ELSE concat_ws('-', g[0], coalesce(g[1], g[3]), coalesce(g[2], g[4])) END")
_CLOCK = "concat_ws(':', coalesce(g[9], '00'), coalesce(g[10], g[13], '00'), coalesce(g[11], g[14], '00'))"
_NAIVE = f"concat({_DATE}, 'T', {_CLOCK}, '.', rpad(substring(coalesce(g[12], g[15], '0'), 1, 6), 6, '0'))"
_OFFSET = [f"coalesce(cast(g[{i}] AS int), 0)" for i in (17, 18, 19)]
_SHIFT = f"(CASE WHEN g[16] = '-' THEN -1 ELSE 1 END * cast(({_OFFSET[0]} * 60 + {_OFFSET[1]}) * 60 + {_OFFSET[2]} AS bigint) * 1000000)"
_OTHER = (
    f"CASE WHEN g[16] IS NULL THEN try_cast({_NAIVE} AS timestamp) WHEN {_OFFSET[0]} < 24 AND {_OFFSET[1]} < 60 AND {_OFFSET[2]} < 60 "
    f"THEN timestamp_micros(unix_micros(try_cast(concat({_NAIVE}, '+00:00') AS timestamp)) - {_SHIFT}) END")
_ISO_OTHER = (
    f"t -> get(transform(array(transform(sequence(1, 20), i -> nullif(regexp_extract(t, r'{_ISO_ANY}', i), ''))), g -> {_OTHER}), 0)")


def parse_timestamp(col: Column | str) -> Column:
    """ISO-8601 text -> TIMESTAMP; blank, 'unknown' and unparseable -> null.

    Calendar and week dates, extended and basic times, comma fractions and
    offsets are read; a year, a month or a time alone is not a date.  Naive text is
    read in the session time zone (the job pins it to UTC).  The rarer shapes
    are read inside ``transform``, which keeps their long expression out of the
    generated code of the usual one.
    """
    text = F.replace(F.trim(_c(col).cast("string")), F.lit("Z"), F.lit("+00:00"))
    other = F.get(F.call_function("transform", F.array(text), F.expr(_ISO_OTHER)), 0)
    return F.when(text.rlike(_ISO_PLAIN), text.try_cast("timestamp")).when(text.rlike(_ISO_ANY), other)


def to_micros(ts: Column | str) -> Column:
    """Epoch microseconds of a TIMESTAMP or TIMESTAMP_NTZ column."""
    return F.unix_micros(_c(ts).cast("timestamp"))


def iso_text(ts: Column | str) -> Column:
    """Render a timestamp as ISO text with microseconds (session zone)."""
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def compose_occurred_at(date_text: Column | str, time_text: Column | str) -> Column:
    """Combine a date column and an optional time column into one ISO text."""
    d = F.trim(F.coalesce(_c(date_text).cast("string"), F.lit("")))
    t = F.trim(F.coalesce(_c(time_text).cast("string"), F.lit("")))
    full_time = (F.length(t) >= 10) & F.substring(t, 1, 4).rlike("^[0-9]{4}$")
    return (
        F.when(full_time, t)
        .when((d != "") & (t != ""), F.concat(F.substring(d, 1, 10), F.lit("T"), F.substring(t, -12, 12)))
        .when(d != "", d)
        .when(t != "", t)
        .otherwise(F.lit("unknown"))
    )


# Decimal number text; digits may be grouped by single underscores.
_NUMBER = r"^[+-]?([0-9]+(_[0-9]+)*(\.([0-9]+(_[0-9]+)*)?)?|\.[0-9]+(_[0-9]+)*)([eE][+-]?[0-9]+(_[0-9]+)*)?$"


def to_number(col: Column | str) -> Column:
    """Text or number -> DOUBLE; '' and bad input -> null."""
    text = F.trim(_c(col).cast("string"))
    named = F.lower(text).rlike(r"^[+-]?(inf|infinity|nan)$")
    return F.when(text.rlike(_NUMBER) | named, F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def fmt_number(col: Column | str) -> Column:
    """Render a DOUBLE the way an integral-or-float value prints: 10.0 -> '10', 1.5E7 -> '15000000'.

    Below 1e16 a fraction prints in plain digits, the shortest that read back
    to the same number; the exponent form starts at 1e16 and below 1e-4.
    """
    c = _c(col)
    size = F.abs(c)
    text = c.cast("string")
    # The shortest digits of the scientific text, moved to their place.
    digits = F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)E", 1), r"\.0?$", "")
    power = F.regexp_extract(text, r"E(-?[0-9]+)$", 1).cast("int")
    bare = F.replace(digits, F.lit("."), F.lit(""))
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    large = F.concat(sign, F.substr(bare, F.lit(1), power + 1), F.lit("."), F.substr(bare, power + 2))
    small = F.concat(sign, F.lit("0."), F.repeat(F.lit("0"), -power - 1), bare)
    exponent = F.concat(sign, digits, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")),
                        F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (F.when(c.isNull(), F.lit("None"))
            .when((c == F.rint(c)) & (size < 1e37), c.cast("decimal(38,0)").cast("string"))
            .when(~text.contains("E"), text)
            .when((size >= 1) & (size < 1e16), large)
            .when((size < 1) & (size >= 1e-4), small)
            .otherwise(exponent))


def _falsy_part(col: Column) -> Column:
    """Text used for a hash part: null, '' and, of numbers and booleans, 0 and false become ''."""
    text = col.cast("string")
    zero = (F.typeof(col) != "string") & ((text == "false") | F.coalesce(text.try_cast("double") == 0, F.lit(False)))
    return F.when(col.isNull() | (text == "") | zero, F.lit("")).otherwise(text)


def record_hash16(*cols: Column | str) -> Column:
    """First 16 hex chars of sha256 over pipe-joined parts (falsy parts -> '')."""
    parts = []
    for i, col in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(_falsy_part(_c(col)))
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 16)


def record_hash20(*cols: Column | str) -> Column:
    """First 20 hex chars of sha256 over pipe-joined parts (null -> 'None')."""
    parts = []
    for i, col in enumerate(cols):
        if i:
            parts.append(F.lit("|"))
        parts.append(F.coalesce(_c(col).cast("string"), F.lit("None")))
    return F.substring(F.sha2(F.concat(*parts), 256), 1, 20)


def normalize_role(col: Column | str) -> Column:
    """trim/lower, '-' and ' ' -> '_', alias table, blank -> 'unassigned'."""
    base = F.translate(F.lower(F.trim(F.coalesce(_c(col).cast("string"), F.lit("")))), "- ", "__")
    aliases = F.create_map(*[F.lit(x) for kv in ROLE_ALIASES.items() for x in kv])
    mapped = F.coalesce(F.element_at(aliases, base), base)
    return F.when(mapped == "", F.lit("unassigned")).otherwise(mapped)


def confirmation_value(answer: Column | str) -> Column:
    """First decisive answer among the confirmation keys: true / false / null."""
    ans = _c(answer)
    decisions = []
    for key in CONFIRMATION_KEYS:
        v = F.lower(F.trim(ans.getField(key).cast("string")))
        decisions.append(
            F.when(v.isin(*CONFIRMATION_YES), F.lit(True)).when(v.isin(*CONFIRMATION_NO), F.lit(False))
        )
    return F.coalesce(*decisions)


def clamp_confidence(col: Column | str) -> Column:
    return F.least(F.greatest(_c(col).cast("double"), F.lit(0.0)), F.lit(1.0))


def ratio4(num: Column | str, den: Column | str) -> Column:
    """num/den rounded half-to-even at 4 decimals on exact integers; 0 if den=0."""
    n = _c(num).cast("bigint")
    d = _c(den).cast("bigint")
    scaled = n * F.lit(10000)
    q = F.floor(scaled / d).cast("bigint")
    rem = scaled - q * d
    up = (rem * 2 > d) | ((rem * 2 == d) & (q % 2 == 1))
    rounded = q + F.when(up, 1).otherwise(0)
    return F.when(d.isNull() | (d == 0), F.lit(0.0)).otherwise(rounded / F.lit(10000.0))


def json_value_type(col: Column | str) -> Column:
    """JSON scalar text -> boolean / integer / number / string."""
    t = F.schema_of_variant(F.try_parse_json(_c(col)))
    return (
        F.when(t == "BOOLEAN", "boolean")
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number")
        .otherwise("string")
    )


def base_units(cartons: Column | str, pack_size: Column | str, loose: Column | str | None = None) -> Column:
    """cartons x pack_size + loose pieces."""
    total = _c(cartons) * _c(pack_size)
    return total + F.coalesce(_c(loose), F.lit(0)) if loose is not None else total


def base_units_from_text(text: Column | str) -> Column:
    """'24*1+5' style text -> 29.0 (cartons*pack[+loose])."""
    t = _c(text)
    cartons = F.regexp_extract(t, r"^\s*([0-9.]+)\s*\*", 1).try_cast("double")
    pack = F.regexp_extract(t, r"\*\s*([0-9.]+)", 1).try_cast("double")
    loose = F.regexp_extract(t, r"\+\s*([0-9.]+)\s*$", 1)
    return cartons * pack + F.coalesce(F.when(loose != "", loose.try_cast("double")), F.lit(0.0))


def summarize_facts(title: Column | str, facts: Column | str) -> Column:
    """'title: k=v, k2=v2' with keys sorted; facts is a MAP<STRING,STRING>."""
    entries = F.array_sort(F.map_entries(_c(facts)))
    pairs = F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("None"))))
    return F.concat(_c(title).cast("string"), F.lit(": "), F.array_join(pairs, ", "))


# Truthiness of a fact value, per declared type ("not facts.get(x)").
def falsy_str(col: Column | str) -> Column:
    c = _c(col)
    return c.isNull() | (c == "")


def falsy_num(col: Column | str) -> Column:
    c = _c(col)
    return c.isNull() | (c == 0)


def falsy_bool(col: Column | str) -> Column:
    c = _c(col)
    return c.isNull() | ~c


def is_camera_source(source: Column | str) -> Column:
    s = F.lower(F.coalesce(_c(source), F.lit("")))
    return s.contains("camera") | s.contains("cctv") | s.contains("vision")
