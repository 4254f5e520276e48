"""Gridded counts out of raw rows: validated as a whole, compacted with their fragments as canonical JSON, and verified again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Digits and places of exact counts, and the letters of grid squares.
DIGITS, PLACES = 38, 5
EAST, NORTH = "가나다라마바사", "가나다라마바사아"
#: What identifies a raw row, and the fields of a fragment in the order in which they are written.
IDENTITY = ["date_raw", "hour_raw", "administrative_dong_code", "cell_id"]
FIELDS = ["administrative_dong_code", "known_value", "total_raw", "masked", "source_file"]
FRAGMENT = "struct<administrative_dong_code:string,known_value:string,total_raw:string,masked:boolean,source_file:string>"
NUMBER = r"^[0-9]+(\.[0-9]*)?$"
DECIMAL = f"decimal({DIGITS},{PLACES})"


def row_faults() -> dict[str, Column]:
    """What a raw row may break, by name; each column says whether it does, null values included."""
    c, total = F.col("cell_id"), F.col("total_raw")
    number = total.rlike(NUMBER)
    lattice = lambda at: F.substring(c, at, 4).try_cast("int") % 25 == 0
    places = F.length(F.split_part(total, F.lit("."), F.lit(2)))
    ok = {
        "date": F.col("date_raw").rlike("^[0-9]{8}$") & F.try_to_timestamp("date_raw", F.lit("yyyyMMdd")).isNotNull(),
        "hour": F.col("hour_raw").rlike("^([01][0-9]|2[0-3])$"),
        "administrative_dong_code": F.col("administrative_dong_code").rlike("^[0-9]{8}$"),
        "cell_id": c.rlike(f"^[{EAST}][{NORTH}][0-9]{{8}}$") & lattice(3) & lattice(7),
        "total": (total == "*") | (number & F.rtrim(total, F.lit(".")).try_cast(DECIMAL).isNotNull()),
        "fraction_scale": (total == "*") | ~number | (places <= PLACES),
    }
    broken = {name: ~F.coalesce(holds, F.lit(False)) for name, holds in ok.items()}
    return broken | {"fraction_scale": F.coalesce(~ok["fraction_scale"], F.lit(False))}


def count_faults(rows: DataFrame) -> DataFrame:
    """One row: total_rows, and how many rows break each rule."""
    return rows.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(bad).alias(f"invalid_{name}") for name, bad in row_faults().items()])


def compact(rows: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """(date, hour, cell_id, known_total, fragment_count, masked_fragment_count, fragments_json) out of valid rows.

    Rows outside allowed (cell_id) are left out; validate before, so that none
    of them hides a fault. Masked fragments, whose total is an asterisk, count
    and don't add; a cell with none but those has total 0. Fragments are in
    the order of code, file and total.
    """
    rows = rows if allowed is None else rows.join(allowed.select("cell_id").distinct(), "cell_id", "left_semi")
    masked = F.col("total_raw") == "*"
    known = F.when(~masked, F.rtrim("total_raw", F.lit(".")).cast(DECIMAL))
    item = F.struct("administrative_dong_code", "source_file", "total_raw", known.cast("string").alias("known_value"), masked.alias("masked"))
    made = rows.groupBy(F.to_date("date_raw", "yyyyMMdd").alias("date"), F.col("hour_raw").cast("int").alias("hour"), "cell_id").agg(
        F.coalesce(F.sum(known).cast(DECIMAL), F.lit(0).cast(DECIMAL)).alias("known_total"),
        F.count(F.lit(1)).cast("int").alias("fragment_count"),
        F.count_if(masked).cast("int").alias("masked_fragment_count"),
        F.sort_array(F.collect_list(item)).alias("_items"),
    )
    written = F.transform("_items", lambda x: F.struct(*[x[f].alias(f) for f in FIELDS]))
    return made.withColumn("fragments_json", as_json(written)).drop("_items")


def as_json(value: Column) -> Column:
    """Compact JSON in the order of the fields, with nulls."""
    return F.to_json(value, {"ignoreNullFields": "false"})


def compact_strictly(rows: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The compacted rows of allowed cells, and the one row of counts that goes into the manifest.

    Every row is checked before the cells are chosen. A row that breaks a
    rule, an identity that stands in two rows, and an allowed cell without
    rows are errors, raised before anything is returned.
    """
    counts = count_faults(rows).first().asDict()
    if broken := {k.removeprefix("invalid_"): n for k, n in counts.items() if k != "total_rows" and n}:
        raise ValueError("rows break rules: " + ", ".join(f"{k}={n}" for k, n in broken.items()))
    again = rows.groupBy(*IDENTITY).count().where("count > 1").orderBy(*IDENTITY).first()
    if again:
        raise ValueError(f"{' '.join(again[:4])} stands in {again[4]} rows")
    missing = allowed.select("cell_id").distinct().join(rows.select("cell_id").distinct(), "cell_id", "left_anti")
    if n := missing.count():
        some = [r[0] for r in missing.orderBy("cell_id").limit(10).collect()]
        raise ValueError(f"{n} allowed cells have no rows: {', '.join(some)}")
    made = compact(rows, allowed)
    return made, made.select(F.lit(counts["total_rows"]).alias("input_rows"), "fragment_count", "masked_fragment_count").groupBy("input_rows").agg(
        F.sum("fragment_count").alias("fragments"),
        F.sum("masked_fragment_count").alias("masked_fragments"),
        F.count(F.lit(1)).alias("cell_hours"),
        F.count_if(F.col("fragment_count") > 1).alias("multi_fragment"),
        F.count_if((F.col("masked_fragment_count") > 0) & (F.col("masked_fragment_count") < F.col("fragment_count"))).alias("partially_masked"),
        F.count_if(F.col("masked_fragment_count") == F.col("fragment_count")).alias("all_masked"),
        F.max("fragment_count").alias("most_fragments"),
    )


def cell_faults(parsed: str = "_f", keys: str = "_keys") -> dict[str, Column]:
    """What a compacted row may break, by name; parsed and keys are its fragments as structs and as sets of names."""
    f, text = F.col(parsed), F.col("fragments_json")
    every = lambda ok: F.forall(f, lambda x: F.coalesce(ok(x), F.lit(False)))
    number = lambda v: F.when(v.rlike(NUMBER), F.rtrim(v, F.lit(".")).try_cast(DECIMAL))
    wanted = F.array_sort(F.array(*map(F.lit, FIELDS)))
    total = F.aggregate(f, F.lit(0).cast(DECIMAL), lambda acc, x: (acc + F.coalesce(F.when(~x.masked, number(x.known_value)), F.lit(0).cast(DECIMAL))).cast(DECIMAL))
    order = F.transform(f, lambda x: F.struct(x.administrative_dong_code, x.source_file, x.total_raw))
    ok = {
        "counts": (F.col("fragment_count") > 0) & F.col("masked_fragment_count").between(0, F.col("fragment_count")),
        "known_total": F.col("known_total") >= 0,
        "json": f.isNotNull(),
        "canonical_json": as_json(f) == text,
        "fragment_count": F.size(f) == F.col("fragment_count"),
        "fields": F.forall(F.col(keys), lambda k: F.array_sort(k) == wanted),
        "code": every(lambda x: x.administrative_dong_code.rlike("^[0-9]{8}$")),
        "source_file": every(lambda x: (x.source_file != "") & (F.trim(x.source_file) == x.source_file)),
        "masked_value": every(lambda x: ~x.masked | (x.known_value.isNull() & (x.total_raw == "*"))),
        "unmasked_value": every(lambda x: x.masked | (number(x.known_value).isNotNull() & number(x.total_raw).isNotNull())),
        "value_is_total": every(lambda x: x.masked | (number(x.known_value) == number(x.total_raw)) | number(x.known_value).isNull() | number(x.total_raw).isNull()),
        "masked_count": F.size(F.filter(f, lambda x: x.masked)) == F.col("masked_fragment_count"),
        "sum": total == F.col("known_total"),
        "order": order == F.array_sort(order),
    }
    return {name: ~F.coalesce(holds, F.lit(False)) for name, holds in ok.items()}


def verify(cells: DataFrame) -> DataFrame:
    """cells, as compact() makes them, with the column faults: the names of all rules that a row breaks, in order.

    The JSON is read twice, as fragments and as names alone, so that a field
    too many or too few is seen. A fault of one kind may entail others.
    """
    parsed = cells.withColumn("_f", F.from_json("fragments_json", f"array<{FRAGMENT}>", {"mode": "PERMISSIVE"}))
    parsed = parsed.withColumn("_keys", F.transform(F.from_json("fragments_json", "array<map<string,string>>"), lambda m: F.map_keys(m)))
    names = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in cell_faults().items()]))
    return parsed.withColumn("faults", names).drop("_f", "_keys")
