"""Scalar text functions as Column expressions; Arrow UDFs are NFKC, which sees values that it may change only, the places of a needle, and the
splitter."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from caselens.functions.batches import pieces
from caselens.functions.evidence import places

# Null lexicons, placeholders and patterns that results depend on.
PROFILE_NULLS = ["", "null", "none", "nan", "n/a", "na"]
DATASET_NULLS = ["", "null", "none", "nan", "n/a"]
LOADER_NULLS = ["null", "nan"]
PLACEHOLDERS = r"\[(?:phone|business_id|license_plate|id_card|name)\]"
MOBILE = r"(?<!\d)1[3-9]\d{9}(?!\d)"
CITIZEN_ID = r"(?<!\d)\d{17}[\dXx](?!\d)"
EMAIL = r"(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+(?![\w.-])"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
LENGTH_BUCKETS = [(50, "01_le_50"), (200, "02_51_200"), (500, "03_201_500"), (2000, "04_501_2000")]
SEGMENT_MARKS = "\n。！？；;"


def strip(c: Column) -> Column:
    """Unicode-aware trim."""
    return F.regexp_replace(c, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def semantic_value(c: Column) -> Column:
    """Trimmed text; null for the profiling null tokens."""
    x = strip(c)
    return F.when(~F.lower(x).isin(PROFILE_NULLS), x)


def dataset_value(c: Column) -> Column:
    """Trimmed text; empty for null and the dataset null tokens."""
    x = strip(F.coalesce(c, F.lit("")))
    return F.when(F.lower(x).isin(DATASET_NULLS), F.lit("")).otherwise(x)


def loader_value(c: Column) -> Column:
    """Text as it is; empty for null and the loader null tokens."""
    x = F.coalesce(c, F.lit(""))
    return F.when(F.lower(strip(x)).isin(LOADER_NULLS), F.lit("")).otherwise(x)


@F.arrow_udf(StringType())
def _nfkc(values: pa.Array) -> pa.Array:
    own = pa.RecordBatch.from_arrays([values], ["v"])
    done = [pa.array([None if v is None else unicodedata.normalize("NFKC", v) for v in piece.column(0).to_pylist()], pa.string()) for piece in pieces(own)]
    return pa.concat_arrays(done) if done else pa.array([], pa.string())


#: Signs that NFKC leaves alone in any company: ASCII, precomposed Latin letters, CJK ideographs and their two stops.
SETTLED = r"\x00-\x7f\u00c0-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u3001\u3002\u3400-\u4dbf\u4e00-\u9fff"


def nfkc(c: Column) -> Column:
    """NFKC; values of settled signs never leave the JVM as payload."""
    return F.coalesce(_nfkc(F.when(c.rlike(f"[^{SETTLED}]"), c)), c)


def content_key(c: Column) -> Column:
    """sha-256 of the NFKC text without any white space."""
    return F.sha2(F.regexp_replace(nfkc(c), r"(?U)\s+", ""), 256)


def tokens(c: Column, normalise: bool = True) -> Column:
    """Latin words whole, CJK runs as overlapping pairs (a lone sign as itself), in order and with repeats."""
    text = F.lower(nfkc(c) if normalise else c)
    runs = F.regexp_extract_all(F.regexp_replace(text, PLACEHOLDERS, " "), F.lit(r"[\u3400-\u9fff]+|[a-z0-9]+"), F.lit(0))
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    cut = F.flatten(F.transform(runs, lambda r: F.when(r.rlike(r"\A[\u3400-\u9fff]{2}"), pairs(r)).otherwise(F.array(r))))
    return F.when(text.rlike(r"[\u3400-\u9fff]{2}"), cut).otherwise(runs)


_PLACEHOLDER, _RUN, _PAIRED = re.compile(PLACEHOLDERS), re.compile(r"[\u3400-\u9fff]+|[a-z0-9]+"), re.compile(r"[\u3400-\u9fff]{2}")


def token_list(text: str | None) -> list[str]:
    """`tokens` of one text, for functions that see whole texts anyway."""
    low = (text or "").lower() if (text or "").isascii() else unicodedata.normalize("NFKC", text).lower()
    if "[" in low:
        low = _PLACEHOLDER.sub(" ", low)
    runs = _RUN.findall(low)
    if low.isascii() or not _PAIRED.search(low):
        return runs
    return [t for r in runs for t in ([r[i : i + 2] for i in range(len(r) - 1)] if _PAIRED.match(r) else [r])]


def stable_rank(seed, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), key), 256)


def pilot_rank(seed, source_id: Column, content_hash: Column) -> Column:
    """Hexadecimal, so that text order is the order of the number."""
    return F.sha2(F.concat(F.lit(f"{seed}\0"), source_id, F.lit("\0"), content_hash), 256)


def length_bucket(n: Column) -> Column:
    out = F.lit("05_gt_2000")
    for most, label in reversed(LENGTH_BUCKETS):
        out = F.when(n <= most, F.lit(label)).otherwise(out)
    return out


def power_bucket(n: Column) -> Column:
    """0 for 0, else the largest power of two that is not larger."""
    return F.when(n <= 0, F.lit(0).cast("long")).otherwise(F.expr("1L") * F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double")))).cast("long"))


def has_mobile(c: Column) -> Column:
    return c.rlike("(?U)" + MOBILE)


def has_citizen_id(c: Column) -> Column:
    return c.rlike("(?U)" + CITIZEN_ID)


def has_email(c: Column) -> Column:
    return c.rlike("(?U)" + EMAIL)


def has_pii(c: Column) -> Column:
    return has_mobile(c) | has_citizen_id(c) | has_email(c)


def safe_display(c: Column) -> Column:
    """The value, or what stands for it: personal data first, then long numbers, then values too long or with control signs."""
    return (
        F.when(has_pii(c), F.lit("<REDACTED_PII_LIKE>"))
        .when(c.rlike(r"(?U)\d{7,}"), F.lit("<REDACTED_LONG_NUMBER>"))
        .when((F.length(c) > 120) | c.rlike(CONTROL), F.lit("<REDACTED_UNSAFE_VALUE>"))
        .otherwise(c)
    )


def integer_like(c: Column) -> Column:
    return c.rlike(r"(?U)\A[+-]?\d+\z")


def has_control(c: Column) -> Column:
    return c.rlike(CONTROL)


def is_multiline(c: Column) -> Column:
    return c.rlike(r"[\n\r]")


def contamination(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\t")), F.lit("EMBEDDED_TABULAR_DATA"))


def safe_cell(c: Column) -> Column:
    """A leading quote for cells that a spreadsheet would run."""
    return F.when(c.rlike(r"(?U)\A\s*[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def annotation_id(query_id: Column, source_id: Column) -> Column:
    json = F.to_json(F.array(query_id, source_id))
    return F.concat(F.lit("pair_"), F.substring(F.sha2(json, 256), 1, 24))


def shared_keywords(a: Column, b: Column, most: int = 10) -> Column:
    return F.slice(F.array_sort(F.array_distinct(F.array_intersect(a, b))), 1, most)


@F.udf(ArrayType(IntegerType()), useArrow=True)
def _occurrences(text, needle):
    return places(text, needle) if text and needle else []


def occurrences(text: Column, needle: Column) -> Column:
    """0-based places of every occurrence, overlapping ones too; empty for an empty needle. One pass over the text, however long."""
    return _occurrences(text, needle)


def path_join(levels: Column, depth: Column) -> Column:
    return F.array_join(F.transform(F.slice(levels, F.lit(1), depth), lambda v: F.coalesce(v, F.lit("<MISSING>"))), " > ")


def period(c: Column, dev_start: str, test_start: str) -> Column:
    """Bit mask of a call time: 1 before dev_start, 2 from dev_start, 4 from test_start, 8 unparsable."""
    ok = c.rlike(r"\A\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}\z")
    parsed = F.when(ok, F.try_to_timestamp(c, F.lit("y-M-d H:m:s")))
    day = F.date_format(parsed, "yyyy-MM-dd")
    return F.when(parsed.isNull(), 8).when(day < dev_start, 1).when(day < test_start, 2).otherwise(4)


def iso_time(c: Column) -> Column:
    """ISO date or date-time, basic or extended, null where it is none. The wall clock counts: an offset is read and left out."""
    shape = r"\A(\d{4})(-?)(\d{2})\2(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,6})\d*)?)?)?(?:Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?)?\z"
    part = lambda i, width: F.rpad(F.regexp_extract(c, shape, i), width, "0")
    plain = F.concat(part(1, 4), F.lit("-"), part(3, 2), F.lit("-"), part(4, 2), F.lit(" "), part(5, 2), F.lit(":"), part(6, 2), F.lit(":"), part(7, 2), F.lit("."), part(8, 6))
    return F.when(c.rlike(shape), F.try_to_timestamp(plain, F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")))


def unit_vector(v: Column, dimension: int) -> Column:
    """The vector at length 1; an error for a wrong size, a value that is not finite, or a norm of 1e-8 or less."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    bad = (F.size(v) != dimension) | F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf"))) | (norm <= 1e-8)
    return F.when(bad, F.raise_error(F.lit("a vector is not usable"))).otherwise(F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def markdown_cell(value) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def percent(x: float | None) -> str:
    return "-" if x is None else f"{x * 100:.2f}%"


def segments(text: str, most: int) -> list[tuple[int, str]]:
    """(offset, part) of a text in parts of at most `most` signs, cut behind the last sentence mark near the limit; lossless."""
    if most < 1000:
        raise ValueError("segments need at least 1000 signs")
    out, at = [], 0
    while len(text) - at > most:
        limit = at + most
        floor = max(at + most // 2, limit - 800)
        cut = next((i + 1 for i in range(limit - 1, floor - 1, -1) if text[i] in SEGMENT_MARKS), limit)
        out.append((at, text[at:cut]))
        at = cut
    if at < len(text) or not out:
        out.append((at, text[at:]))
    return out


def split_document(most: int):
    """UDF: array<struct<offset, text>> of a text's segments."""

    @F.udf("array<struct<offset:int,text:string>>", useArrow=True)
    def split(text):
        return None if text is None else segments(text, most)

    return split
