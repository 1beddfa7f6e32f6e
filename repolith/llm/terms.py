"""How distinctive a term is for a record: log-entropy weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from repolith.storage import materialize

# Fixed value: what counts as a term of a lower-cased message.
TERM = r"[a-z][a-z0-9_-]{2,}|[\x{4e00}-\x{9fff}]{2,}"


def log_entropy(df: DataFrame, record: str, unit: str, text: str, pattern: str = TERM) -> DataFrame:
    """(record, term, tf, records, weight) of every term of every record.

    ``tf`` is the number of units (commits) of the record with the term: a unit
    delivered several times counts once, with the terms of all its texts;
    ``records`` the number of records with it.  The weight is
    log(1 + tf) * (1 - H / log N), where H is the entropy of the term's spread
    over the records and N their number: 0 for a term spread evenly over all, and
    log(1 + tf) for one in a single record.  With one record every weight is
    log(1 + tf).  Rows without record, unit or text have no terms; a record
    counts for N if it has a unit.  Empty input gives no rows.

    Two aggregations: terms by record, then spread by term.  Both have a partial
    step before the shuffle.  The first is written, as it is read twice; the join
    back is by term, where adaptive execution splits what is skewed.
    """
    units = (
        df.select(F.col(record).alias("r"), F.col(unit).alias("u"), F.col(text).alias("t"))
        .filter("r is not null and u is not null")
        .groupBy("r", "u")
        .agg(F.collect_set("t").alias("t"))  # a unit's deliveries are few, and equal ones count once
    )
    found = F.array_distinct(F.flatten(F.transform("t", lambda t: F.regexp_extract_all(F.lower(t), F.lit(pattern), F.lit(0)))))
    local = materialize(units.select("r", F.explode(found).alias("term")).groupBy("r", "term").agg(F.count("*").alias("tf")), "terms")
    spread = local.groupBy("term").agg(
        F.count("*").alias("records"),
        F.sum("tf").alias("all"),
        F.sum(F.col("tf") * F.log("tf")).alias("s"),
    )
    n = max(2, df.filter(F.col(record).isNotNull() & F.col(unit).isNotNull()).agg(F.count_distinct(record)).first()[0])
    entropy = F.log("all") - F.col("s") / F.col("all")
    weight = F.log1p("tf") * (1 - entropy / F.log(F.lit(float(n))))
    return (
        local.join(spread, "term")
        .select(F.col("r").alias(record), "term", "tf", "records", F.greatest(weight, F.lit(0.0)).alias("weight"))
    )
