"""Evaluating many saved dashboard searches at once.

The report stores the sales in blocks, sorted by each value that it takes a median of. The first
pass lets blocks and packed searches of a department meet and counts the matches of every search by block.
The counts say in which block each median lies and how far in; the second pass joins on that block
too, so only the few sales around a median meet its search. No join of packed rows is left to Spark's guess
of sizes, which takes them for small and would send them through the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcella import schema as S
from parcella.functions import columns as C
from parcella.operators import search_blocks as B
from parcella.session import importable
from parcella.sources.tables import materialise

ANY = "any"
ALL = "all"
OK, MALFORMED = "ok", "malformed"

# Keys of a shareable address and the bounds they set.
_BOUNDS = {
    "pmin": "price_min",
    "pmax": "price_max",
    "amin": "area_min",
    "amax": "area_max",
    "lamin": "land_min",
    "lamax": "land_max",
}
_YEARS = {"ymin": ("year_min", S.DEFAULT_YEARS[0]), "ymax": ("year_max", S.DEFAULT_YEARS[1])}


def _fields(query: Column) -> Column:
    """Decoded (key, value) pairs of an address, in order; a key without = has an empty value."""
    parts = F.split(F.regexp_replace(F.coalesce(query, F.lit("")), r"^\?+", ""), "&")

    def pair(p: Column) -> Column:
        cut = F.instr(p, "=")
        value = F.when(cut > 0, F.substr(p, cut + 1)).otherwise("")
        key = F.when(cut > 0, F.substr(p, F.lit(1), cut - 1)).otherwise(p)
        return F.struct(F.try_url_decode(key).alias("key"), F.try_url_decode(value).alias("value"))

    return F.transform(F.filter(parts, lambda p: p != ""), pair)


def _number(text: Column) -> Column:
    """NULL when the text is absent or no number, zero when it is empty."""
    return F.when(text == "", F.lit(0.0)).otherwise(text.try_cast("double"))


def _is_bad(text: Column) -> Column:
    return (text != "") & text.try_cast("double").isNull()


def _spec(part: Column) -> Column:
    """The parts of ``type:aMin:aMax:rMin:rMax``; unknown types mean any, empty means open."""

    def bound(i: int) -> Column:
        return F.nullif(F.get(part, F.lit(i)), F.lit("")).try_cast("double")

    kind = F.get(part, F.lit(0))
    return F.struct(
        F.when(kind.isin(S.HOUSE, S.APARTMENT), kind).otherwise(ANY).alias("type"),
        bound(1).alias("area_min"),
        bound(2).alias("area_max"),
        bound(3).alias("rooms_min"),
        bound(4).alias("rooms_max"),
    )


def decode_searches(searches: DataFrame) -> DataFrame:
    """(search_id, query) rows to one column per filter, defaults filled in.

    The same contract as :meth:`SaleFilter.from_query`; a search that it would
    refuse has the status ``malformed`` here. ``specs`` holds each distinct
    building spec once, with how often it was given. Each step is a projection
    of its own and small, as the plan holds all of them wherever searches are used.
    """
    keys = {key: f"_{key}" for key in (*_YEARS, *_BOUNDS, "dept", "bs")}
    fields = searches.select("search_id", _fields(F.col("query")).alias("f"))
    lists = fields.select("search_id", F.col("f.key").alias("keys"), F.col("f.value").alias("given"))
    # The first value of a key; nothing stands before the first place.
    values = lists.select(
        "*", *[F.get("given", F.array_position("keys", key) - 1).alias(name) for key, name in keys.items()]
    )
    parts = values.withColumn("parts", F.filter(F.split(F.coalesce("_bs", F.lit("")), ";"), lambda p: p != ""))
    parts = parts.withColumn("parts", F.transform("parts", lambda p: F.split(p, ":")))
    specs = parts.withColumn("specs", F.transform("parts", _spec))
    bad = F.exists("keys", lambda k: k.isNull()) | F.exists("given", lambda v: v.isNull())
    bad = bad | F.exists("parts", lambda p: F.exists(F.slice(p, 2, 4), _is_bad))
    numbers = F.array(*[F.col(keys[key]) for key in (*_YEARS, *_BOUNDS)])
    bad = bad | F.exists(numbers, lambda v: F.coalesce(_is_bad(v), F.lit(False)))
    return specs.select(
        "search_id",
        F.when(bad, MALFORMED).otherwise(OK).alias("status"),
        *[
            F.coalesce(_number(F.col(keys[key])).cast("int"), F.lit(default)).alias(name)
            for key, (name, default) in _YEARS.items()
        ],
        F.coalesce("_dept", F.lit(ALL)).alias("department"),
        *[_number(F.col(keys[key])).alias(name) for key, name in _BOUNDS.items()],
        F.transform(
            F.array_distinct("specs"),
            lambda s: F.struct(s.alias("spec"), F.size(F.filter("specs", lambda o: o == s)).alias("n")),
        ).alias("specs"),
    )


def _within(value: str, low: str, high: str) -> Column:
    v = F.col(value)
    return (F.col(low).isNull() | (v >= F.col(low))) & (F.col(high).isNull() | (v <= F.col(high)))


def _building_matches(b: Column, s: Column) -> Column:
    def inside(value, low, high):
        return F.coalesce((low.isNull() | (value >= low)) & (high.isNull() | (value <= high)), F.lit(False))

    return (
        ((s["type"] == ANY) | (b["type"] == s["type"]))
        & inside(b["area_m2"], s["area_min"], s["area_max"])
        & inside(b["rooms"], s["rooms_min"], s["rooms_max"])
    )


#: Columns of a sale with its number of buildings of a type; the type of a spec counts towards its own and all.
_NUMBERS = {S.HOUSE: "n_maisons", S.APARTMENT: "n_appartements"}


def _needed(kind: str | None) -> Column:
    """The most buildings of a type that one spec asks for."""
    own = F.filter("specs", lambda w: F.lit(True) if kind is None else w["spec"]["type"] == kind)
    return F.coalesce(F.array_max(F.transform(own, lambda w: w["n"])), F.lit(0))


def _specs_met() -> Column:
    """Numbers of buildings first, then the buildings themselves."""
    enough = F.col("n_maisons") + F.col("n_appartements") >= F.col("_needed")
    for number in _NUMBERS.values():
        enough = enough & (F.col(number) >= F.col(f"_needed_{number}"))
    return enough & F.forall(
        "specs",
        lambda w: F.size(F.filter("buildings", lambda b: _building_matches(b, w["spec"])))
        >= w["n"],
    )


def _with_years(sales: DataFrame, searches: DataFrame) -> DataFrame:
    """Decoded searches with the years with sales that they cover, none for malformed ones."""
    domain = sales.agg(F.min("year").alias("first"), F.max("year").alias("last"))
    first, last = domain.select("first").scalar(), domain.select("last").scalar()
    low, high = F.greatest("year_min", first), F.least("year_max", last)
    needed = {"_needed": _needed(None)} | {f"_needed_{number}": _needed(kind) for kind, number in _NUMBERS.items()}
    decoded = decode_searches(searches).withColumns(needed)
    return decoded.withColumn("years", F.when((F.col("status") == OK) & (low <= high), F.sequence(low, high)))


def _by_year(decoded: DataFrame) -> DataFrame:
    """Searches, once for each of their years."""
    return decoded.withColumn("year", F.explode("years")).drop("years")


def _facts(sales: DataFrame, *columns: Column | str) -> DataFrame:
    """What searches look at; a sale stands under its department and under ``all``."""
    return sales.select(
        "year",
        "price_eur",
        "built_area_m2",
        "land_area_m2",
        "buildings",
        *_NUMBERS.values(),
        *columns,
        F.explode(F.array(F.col("department_code"), F.lit(ALL))).alias("department"),
    )


def _joined(facts: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """Sales and the searches they pass, the cheap conditions tested first."""
    return facts.join(wanted, ["year", "department", *keys]).where(
        _within("price_eur", "price_min", "price_max")
        & _within("built_area_m2", "area_min", "area_max")
        & _within("land_area_m2", "land_min", "land_max")
        & _specs_met()
    )


def matching_pairs(sales: DataFrame, searches: DataFrame) -> DataFrame:
    """(search, sale) pairs where the sale passes the search.

    An equality join on year and department finds the candidates; the other bounds are
    checked inside the join. Spark broadcasts the searches if it sees that they are few,
    and otherwise splits the tasks of a year and department that has very many sales.
    Malformed searches match nothing.
    """
    facts = _facts(sales, "id_mutation", "price_per_m2")
    pairs = _joined(facts, _by_year(_with_years(sales, searches)))
    return pairs.select("search_id", "id_mutation", "price_eur", "price_per_m2")


#: Medians of the report, and how the value behind each is computed.
_SERIES = {"median_price": lambda: F.col("price_eur"), "median_per_m2": C.plausible_ppm2}


def _asked(decoded: DataFrame) -> DataFrame:
    """(search_id, department, filters): the filters of each id that may match, as bounds of the columns of blocks.

    An id may repeat. If its rows name several departments, they all look at all sales and test the department.
    """
    bounds = lambda *names: F.array(*[F.col(n).cast("double") if isinstance(n, str) else n for n in names])
    none = F.lit(None).cast("double")
    first, last = (F.element_at("years", i).cast("double") for i in (1, -1))
    rows = decoded.where("years IS NOT NULL AND search_id IS NOT NULL").select(
        "search_id",
        F.struct(
            "department",
            bounds("price_min", "area_min", "land_min", first, "_needed", *[f"_needed_{n}" for n in _NUMBERS.values()]).alias("low"),
            bounds("price_max", "area_max", "land_max", last, none, *[none for _ in _NUMBERS]).alias("high"),
            "specs",
        ).alias("f"),
    )
    each = rows.groupBy("search_id").agg(
        F.collect_list("f").alias("filters"), F.min("f.department").alias("least"), F.max("f.department").alias("most")
    )
    each = each.withColumn("department", F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(ALL))

    def placed(f: Column) -> Column:
        own = F.when((F.col("department") == ALL) & (f["department"] != ALL), F.xxhash64(f["department"]))
        return F.struct(f["low"], f["high"], own.alias("own"), f["specs"])

    return each.select("search_id", "department", F.transform("filters", placed).alias("filters"))


def _blocks(sales: DataFrame) -> DataFrame:
    """Sales in blocks of :mod:`search_blocks`, once for each median, under their department and under ``all``."""
    numbers = [F.col(c).cast("double") for c in ("price_eur", "built_area_m2", "land_area_m2", "year")]
    counts = [F.col(n) for n in _NUMBERS.values()]
    numbers += [c.cast("double") for c in (sum(counts[1:], counts[0]), *counts)]
    series = F.array(
        *[
            F.named_struct(F.lit("series"), F.lit(name), F.lit("value"), value().cast("double"))
            for name, value in _SERIES.items()
        ]
    )
    facts = _facts(
        sales,
        F.array(*numbers).alias("numbers"),
        F.when(F.col("department_code").isNotNull(), F.xxhash64("department_code")).alias("own"),
        F.xxhash64("id_mutation").alias("id"),
        series.alias("measured"),
    )
    facts = facts.select("numbers", "own", "buildings", "id", "department", F.inline("measured")).where(
        # The first series counts the matches, those without a value too.
        F.col("department").isNotNull() & ((F.col("series") == next(iter(_SERIES))) | F.col("value").isNotNull())
    )
    # Numbers sort faster than names. The id is a range key, so that a value that very many sales share is cut too.
    keyed = facts.withColumn("key", F.xxhash64("series", "department"))
    ranged = keyed.repartitionByRange("key", "value", "id").sortWithinPartitions("key", "value").drop("key", "id")
    return materialise(ranged.mapInArrow(B.pack_sales, B.SALES), "blocks")


def _packed(searches: DataFrame, keys: list[str], *also: str) -> DataFrame:
    """Searches that agree in ``keys``, packed by :func:`search_blocks.pack_searches`."""
    kinds = dict(searches.dtypes)
    lists = [f"{name}s array<{kinds[name]}>" for name in ("search_id", *also)]
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], *lists, "conditions binary"])
    return searches.sortWithinPartitions(*keys).mapInArrow(B.pack_searches(keys, list(also)), schema)


def _histogram(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(search_id, series, range, n): matches by block of each value; range NULL where it is missing.

    The searches of a department are copied for each share of its blocks, so no task has to
    meet all blocks of a department.
    """
    packed = _packed(asked.repartitionByRange("department", "search_id"), ["department"])
    shares = blocks.select("department", "share").distinct()
    spread = packed.hint("merge").join(shares, "department")
    kind = dict(asked.dtypes)["search_id"]
    pairs = blocks.hint("merge").join(spread, ["department", "share"])
    counts = pairs.mapInArrow(B.count, f"search_id {kind}, series string, range long, n long")
    return counts.groupBy("search_id", "series", "range").agg(F.sum("n").alias("n"))


def _targets(histogram: DataFrame) -> DataFrame:
    """Ranges with a wanted rank: at most two a search and series, with the ranks counted from their start.

    The windows see no more rows than there are ranges. Missing values are counted as none instead
    of being filtered out: a filter would move below the counts, and they could not be shared.
    """
    group = Window.partitionBy("search_id", "series")
    upto = group.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    valued = histogram.withColumn("n", F.when(F.col("range").isNull(), 0).otherwise(F.col("n")))
    ranked = valued.select(
        "*", F.sum("n").over(group).alias("all"), (F.sum("n").over(upto) - F.col("n")).alias("before")
    )
    low, high = F.floor((F.col("all") - 1) / 2), F.ceil((F.col("all") - 1) / 2)
    inside = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("n"))
    return ranked.where(inside(low) | inside(high)).select(
        "search_id",
        "series",
        "range",
        F.when(inside(low), low - F.col("before")).alias("low"),
        F.when(inside(high), high - F.col("before")).alias("high"),
    )


def _medians(blocks: DataFrame, asked: DataFrame, targets: DataFrame) -> DataFrame:
    """(search_id, series, median) from the blocks in which wanted ranks lie."""
    keys = ["series", "department", "range"]
    near = asked.hint("merge").join(targets, "search_id").repartition(*keys)
    pairs = blocks.hint("merge").join(_packed(near, keys, "low", "high"), keys)
    kind = dict(asked.dtypes)["search_id"]
    picked = pairs.mapInArrow(B.pick, f"search_id {kind}, series string, low double, high double")
    found = picked.groupBy("search_id", "series").agg(F.max("low").alias("low"), F.max("high").alias("high"))
    return found.select("search_id", "series", ((F.col("low") + F.col("high")) / 2).alias("median"))


def saved_search_report(sales: DataFrame, searches: DataFrame) -> DataFrame:
    """Status, number of sales and medians of every saved search.

    The decoded searches are stored once: decoding is a long expression, and the plan
    would hold and compile it wherever they are read. So are the blocks. The counts by range serve twice, for
    the number of sales and for the second pass; Spark shuffles them once.
    """
    importable(sales.sparkSession)
    decoded = materialise(_with_years(sales, searches), "searches")
    asked, blocks = _asked(decoded), _blocks(sales)
    histogram = _histogram(blocks, asked)
    of_one = F.when(F.col("series") == next(iter(_SERIES)), F.col("n"))
    counts = histogram.groupBy("search_id").agg(F.sum(of_one).alias("n_sales"))
    medians = _medians(blocks, asked, _targets(histogram)).groupBy("search_id").agg(
        *[F.round(F.max(F.when(F.col("series") == name, F.col("median")))).cast("bigint").alias(name) for name in _SERIES]
    )
    return (
        decoded.select("search_id", "status")
        .join(counts, "search_id", "left")
        .join(medians, "search_id", "left")
        .withColumn(
            "n_sales",
            F.when(F.col("status") == OK, F.coalesce("n_sales", F.lit(0).cast("bigint"))),
        )
    )
