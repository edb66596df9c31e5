"""Mixed timestamp formats and zones to one UTC instant (problem 3).

Every value has one reading per valid parse: each format whose pattern it fits, either order of day and month in an
all-number slash date, every meaning of a zone abbreviation that has several, each unit of a bare integer that gives a
plausible year. Each source is a mixture over these interpretations. Expectation-maximisation fits its weights: a value
adds to each of its readings in proportion to weight and documentation; values with a single reading are the evidence
that settles the others. The posterior picks the reading and marks what stays unresolved.

Documentation (the source's order of dates, its own zone, the length of integers) is a likelihood of TRUST for the
reading that agrees with it and of 1 - TRUST for one that doesn't, per value: it weighs the same at every size, and a
source without documentation is decided by its own values alone. Readings of one format never compete with those of
another, so the mixture falls apart into the formats and only values with several readings and their siblings matter.

Defined results: null, empty, blank and meaningless values, impossible dates and impossible times give no instant.
A value whose best posterior is under `certain` keeps its best reading and is marked `ambiguous`; of equal posteriors the
first reading is taken (month first, the unit by length, the first meaning listed). A null or unknown zone of the source
is read as UTC. Repeated rows give equal rows and count as evidence each; extra columns are left alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"
_ISO = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ](\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?)? ?([Zz]|[+-]\d{2}:?\d{2}|[+-]\d{2}|[A-Za-z]{3,5})?$"
_BASIC = r"^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(?:(\d{2})(?:[.,](\d+))?)? ?([Zz]|[+-]\d{2}:?\d{2})?$"
_DAY_NAME = r"^(?:[A-Za-z]+,? )?(\d{1,2}) ([A-Za-z]{3,9})\.?,? (\d{4})(?:,? (?:at )?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?)?(?: ([Zz]|[+-]\d{2}:?\d{2}|[A-Za-z]{3,5}))?$"
_NAME_DAY = r"^(?:[A-Za-z]+,? )?([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})(?:,? (?:at )?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?)?(?: ([Zz]|[+-]\d{2}:?\d{2}|[A-Za-z]{3,5}))?$"
_SLASH = r"^(\d{1,2})/(\d{1,2})/(\d{4})(?:,? (?:at )?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?(?: ?([AaPp])\.?[Mm]\.?)?)?(?: ([Zz]|[+-]\d{2}:?\d{2}|[A-Za-z]{3,5}))?$"

MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
#: Offsets in minutes of zone abbreviations with one meaning.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180,
    "EST": -300, "EDT": -240, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "JST": 540, "AEST": 600, "AEDT": 660,
}
#: Abbreviations with several meanings: the zone that each belongs to, and its offset. The first without a zone is the usual one.
MEANINGS = {
    "IST": (("Asia/Kolkata", 330), ("Europe/Dublin", 60), ("Asia/Jerusalem", 120)),
    "CST": (("America/Chicago", -360), ("Asia/Shanghai", 480)),
}
#: Documented readings have this likelihood, others the rest.
TRUST = 0.99
DAY_US = 86_400_000_000
#: Microseconds of 1990 and 2100: a bare integer is read in another unit than its length says only in between.
PLAUSIBLE = (631_152_000_000_000, 4_102_444_800_000_000)


#: For each format its pattern and where year, month, day, hour, minute, second, fraction, half of day and zone stand.
_FORMATS = {
    "iso": (_ISO, "$1|$2|$3|$4|$5|$6|$7||$8"),
    "basic": (_BASIC, "$1|$2|$3|$4|$5|$6|$7||$8"),
    "day_name": (_DAY_NAME, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "name_day": (_NAME_DAY, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "slash": (_SLASH, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
}


def _let(value: Column, f) -> Column:
    """f(value) with value computed once: a bound variable keeps the plan small, whatever f does with it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970, null for a date that doesn't exist or lies before the year 1."""
    ok = (y > 0) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.unix_date(F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d))))


def _offsets(zone: Column, tz: Column) -> Column:
    """Array of name, offset from UTC in minutes and documentation of each meaning of a written zone in capitals."""
    sign = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1)
    digits = F.rpad(F.regexp_replace(zone, "[^0-9]", ""), 4, "0")
    numeric = sign * (F.substring(digits, 1, 2).cast("int") * 60 + F.substring(digits, 3, 2).cast("int"))
    table = F.create_map(*[x for k, v in ABBREVIATIONS.items() for x in (F.lit(k), F.lit(v))])
    one = F.when(zone == "Z", F.lit(0)).when(zone.rlike(r"^[+-]"), numeric).otherwise(F.element_at(table, zone))
    meaning = lambda name, minutes, doc: F.struct(name.alias("name"), minutes.alias("minutes"), doc.alias("doc"))
    out = F.array(meaning(F.lit(""), one, F.lit(1.0)))
    for name, places in MEANINGS.items():
        own = F.array_contains(F.array(*[F.lit(where) for where, _ in places]), tz)
        first = [F.when(own, tz == where).otherwise(F.lit(k == 0)) for k, (where, _) in enumerate(places)]
        out = F.when(zone == name, F.array(*[meaning(F.lit(f"{name}{minutes:+d}"), F.lit(minutes), F.when(tz.isNull(), F.lit(0.5)).when(f, F.lit(TRUST)).otherwise(F.lit(1 - TRUST))) for f, (_, minutes) in zip(first, places)])).otherwise(out)
    return out


def _reading(name: Column, us: Column, doc: Column) -> Column:
    return F.struct(name.alias("name"), us.alias("us"), doc.cast("double").alias("doc"))


def _read(value: Column, tz: Column, order: Column) -> Column:
    """Array of the value's readings: name, instant in microseconds and likelihood of the documentation."""
    none = F.array().cast("array<struct<name:string,us:bigint,doc:double>>")

    def with_parts(v: Column, kind: Column) -> Column:
        parts = F.lit(None).cast("string")
        for name, (pattern, places) in _FORMATS.items():
            parts = F.when(kind == name, F.regexp_replace(v, pattern, places)).otherwise(parts)
        return _let(F.split(parts, r"\|", -1), lambda p: _let(fields(p), lambda f: _let(walls(f), lambda w: instants(kind, f, w))))

    def fields(p: Column) -> Column:
        number = lambda i: p[i].try_cast("int")
        month = F.nullif(F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(p[1], 1, 3))).cast("int"), F.lit(0))
        pm, h = F.lower(p[7]), number(3)
        hour = F.when(pm == "", h).when(h.between(1, 12), h % 12 + F.when(pm == "p", 12).otherwise(0))
        micros = F.coalesce(F.rpad(F.substring(p[6], 1, 6), 6, "0").try_cast("long"), F.lit(0).cast("long"))
        return F.struct(number(0).alias("y"), F.coalesce(number(1), month).alias("m"), number(2).alias("d"), hour.alias("h"), number(4).alias("mi"), F.coalesce(number(5), F.lit(0)).alias("s"), micros.alias("us"), (p[3] == "").alias("no_time"), F.nullif(F.upper(p[8]), F.lit("")).alias("zone"))

    def walls(f: Column) -> Column:
        fits = f["h"].between(0, 23) & f["mi"].between(0, 59) & f["s"].between(0, 59)
        clock = F.when(f["no_time"], F.lit(0).cast("long")).when(fits, (f["h"] * 3600 + f["mi"] * 60 + f["s"]).cast("long") * 1_000_000 + f["us"])
        wall = lambda c, m, d: _days(f["y"], m, d).cast("long") * DAY_US + c
        return _let(clock, lambda c: F.struct(wall(c, f["m"], f["d"]).alias("md"), wall(c, f["d"], f["m"]).alias("dm")))

    def instants(kind: Column, f: Column, w: Column) -> Column:
        local = lambda x: F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(x), F.coalesce(tz, F.lit("UTC"))))
        agrees = lambda o: F.when(F.upper(order) == o, F.lit(TRUST)).when(F.upper(order).isin("MDY", "DMY"), F.lit(1 - TRUST)).otherwise(F.lit(0.5))
        wall = lambda name, x, doc: F.struct(name.alias("name"), x.alias("x"), doc.alias("doc"))
        slash = F.array(wall(F.lit("slash:md"), w["md"], agrees("MDY")), wall(F.lit("slash:dm"), w["dm"], agrees("DMY")))
        both = F.when(kind == "slash", slash).otherwise(F.array(wall(kind, w["md"], F.lit(1.0))))
        at = lambda x: F.when(f["zone"].isNull(), F.array(_reading(x["name"], local(x["x"]), x["doc"]))).otherwise(F.transform(_offsets(f["zone"], tz), lambda o: _reading(F.concat(x["name"], F.when(o["name"] == "", F.lit("")).otherwise(F.concat(F.lit(":"), o["name"]))), x["x"] - o["minutes"].cast("long") * 60_000_000, x["doc"] * o["doc"])))
        return F.flatten(F.transform(both, at))

    def of_kind(v: Column, kind: Column) -> Column:
        n = v.try_cast("long")
        unit = lambda name, digits, size: _reading(F.lit(f"epoch:{name}"), F.when((n >= PLAUSIBLE[0] // size) & (n < PLAUSIBLE[1] // size), n * size), F.when(F.length(v) == digits, F.lit(TRUST)).otherwise(F.lit(1 - TRUST)))
        by_length = _reading(F.concat(F.lit("epoch:"), F.when(F.length(v) == 10, "s").when(F.length(v) == 13, "ms").otherwise("us")), n * F.when(F.length(v) == 10, 1_000_000).when(F.length(v) == 13, 1_000).otherwise(1), F.lit(TRUST))
        others = F.filter(F.array(unit("s", 10, 1_000_000), unit("ms", 13, 1_000), unit("us", 16, 1)), lambda r: r["doc"] < 0.5)
        return F.when(kind.isNull(), none).when(kind == "epoch", F.concat(F.array(by_length), others)).otherwise(with_parts(v, kind))

    def kind_of(v: Column) -> Column:
        kind = F.when(v.rlike(r"^\d{10}$|^\d{13}$|^\d{16}$"), F.lit("epoch"))
        for name, (pattern, _) in _FORMATS.items():
            kind = kind.when(v.rlike(pattern), F.lit(name))
        return kind

    read = _let(F.trim(F.regexp_replace(value, r"\s+", " ")), lambda v: _let(kind_of(v), lambda kind: of_kind(v, kind)))
    return F.filter(F.coalesce(read, none), lambda r: r["us"].isNotNull())


def readings(values: DataFrame, value: str, tz: str, order: str) -> DataFrame:
    """Add _r, the readings of each value.

    Java's rule for local times gives the first of two equal wall clocks and the old offset in a gap. The generator
    keeps filters on the result from being pushed into copies of the parser.
    """
    return values.select("*", F.explode(F.array(_read(F.col(value), F.col(tz), F.col(order)))).alias("_r"))


def fit_weights(sets: list[list[str]], docs: list[list[float]], counts: np.ndarray, steps: int = 50, pseudo: float = 0.5) -> dict[str, float]:
    """EM of one source: sets of readings that values have, their documentation, and how many values have each set."""
    names = sorted({x for s in sets for x in s})
    at = {x: i for i, x in enumerate(names)}
    like = np.zeros((len(sets), len(names)))
    for i, (s, d) in enumerate(zip(sets, docs)):
        for x, p in zip(s, d):
            like[i, at[x]] = p
    w = np.full(len(names), 1 / len(names))
    for _ in range(steps):
        share = like * w
        share *= (counts / share.sum(1))[:, None]
        w = (share.sum(0) + pseudo) / (counts.sum() + pseudo * len(names))
    return dict(zip(names, w.tolist()))


def format_mixture(read: DataFrame, source: str) -> DataFrame:
    """_source, weights (a map of reading to weight): the EM of each source, over counts of equal sets of readings.

    The counts are aggregated before they meet; a source has as many sets as there are combinations of readings.
    """
    names = F.transform("_r", lambda r: F.concat_ws("=", r["name"], r["doc"].cast("string")))
    sets = read.filter(F.size("_r") > 0).groupBy(F.col(source).cast("string").alias("_source"), F.array_join(names, "|").alias("readings")).agg(F.count("*").alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        split = [[x.rsplit("=", 1) for x in s.split("|")] for s in frame["readings"]]
        w = fit_weights([[n for n, _ in s] for s in split], [[float(d) for _, d in s] for s in split], frame["n"].to_numpy(float))
        return pd.DataFrame({"_source": [frame["_source"].iloc[0]], "names": [list(w)], "w": [list(w.values())]})

    fitted = sets.groupBy("_source").applyInPandas(run, "_source string, names array<string>, w array<double>")
    return fitted.select("_source", F.map_from_arrays("names", "w").alias("weights"))


def normalise_timestamps(values: DataFrame, value: str, source: str, tz: str, order: str, certain: float = 0.9) -> DataFrame:
    """Add instant_us, format, posterior and ambiguous to each row of values.

    Formats don't compete, so the mixture is fitted on the values of those formats that can have several readings. The
    sources are a dimension: their mixture has a row per source, so it is joined by hash with no broadcast hint.
    """
    several = F.col(value).rlike(r"/|^\s*\d{10,16}\s*$|(?i)\b(?:" + "|".join(MEANINGS) + r")\b")
    weights = format_mixture(readings(values.filter(several), value, tz, order), source).withColumnRenamed("weights", "_weights")
    joined = readings(values, value, tz, order).join(weights, F.col(source).cast("string").eqNullSafe(F.col("_source")), "left")
    scored = F.transform("_r", lambda r: F.struct((r["doc"] * F.coalesce(F.try_element_at(F.col("_weights"), r["name"]), F.lit(1e-9))).alias("p"), r["name"].alias("name"), r["us"].alias("us")))
    best = F.aggregate("_s", F.element_at("_s", 1), lambda a, r: F.when(r["p"] > a["p"], r).otherwise(a))
    mass = lambda at: F.aggregate("_s", F.lit(0.0), lambda a, r: a + F.when(F.lit(at is None) | (r["us"] == at if at is not None else F.lit(True)), r["p"]).otherwise(0.0))
    out = joined.withColumn("_s", scored).withColumn("_b", F.when(F.size("_s") == 1, F.element_at("_s", 1)).when(F.size("_s") > 1, best))
    posterior = F.when(F.size("_s") == 1, F.lit(1.0)).when(F.size("_s") > 1, mass(F.col("_b.us")) / mass(None))
    out = out.withColumns({"instant_us": F.col("_b.us"), "format": F.col("_b.name"), "posterior": posterior})
    return out.withColumn("ambiguous", F.col("instant_us").isNotNull() & (F.col("posterior") < certain)).drop("_r", "_s", "_b", "_weights", "_source")


FIELDS = ["published_date", "modified_date", "scraped_at"]


def article_times(articles: DataFrame, authors: DataFrame, outlets: DataFrame) -> DataFrame:
    """Long form id, field, value with the outlet's zone and date order of the article's author."""
    place = authors.select(F.col("id").alias("author_id"), "outlet").join(outlets.select("outlet", "tz_name", "date_order"), "outlet", "left")
    long = articles.select("id", "author_id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in FIELDS])).alias("x"))
    return long.select("id", "author_id", "x.field", "x.value").filter(F.trim("value") != "").join(place, "author_id", "left")


def found_timestamps(articles: DataFrame, authors: DataFrame, outlets: DataFrame) -> DataFrame:
    """Distinct id, field, instant_us of every value that denotes an instant and isn't in the normal form already."""
    long = article_times(articles, authors, outlets).filter(~F.col("value").rlike(EXACT))
    out = normalise_timestamps(long, "value", "outlet", "tz_name", "date_order")
    return out.filter("instant_us is not null").select("id", "field", "instant_us").distinct()
