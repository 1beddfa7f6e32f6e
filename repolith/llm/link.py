"""Linking the identities of one person or organisation.

Neither a name nor a mailbox alone makes two identities one.  Evidence is put
into nodes, to which identities are tied, and components of the ties are the
entities:

- a mailbox node (handle, name): identities that use the handle, and whose names
  are variants of the name most used with it, be it in one word or in both;
- a name node: identities with this name, or a variant that nobody else bears,
  unless the name is known to belong to several people: unless it is used with
  several handles that cannot be derived from it.

The driver keeps plans, threads and tasks of every exchange, however few its
rows are.  So plans are cut where they get long, what a key says itself is not
joined, and ties of one identity become links between nodes before components
are sought.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from repolith.llm.components import components
from repolith.llm.names import any_of, derived, handles_of, name_pairs, parsed
from repolith.storage import materialize


#: A word of at most FEW names next to one of MANY times as many is a slip in typing.
FEW, MANY = 2, 4
#: A short form is learned where so many families show it, and so much of what stands beside the word is the long form.
FAMILIES, SHARE = 3, 0.5


def _letters(handle: Column) -> Column:
    return F.regexp_replace(handle, "[^a-z]", "")


def _key(x: Column, y: Column) -> Column:
    """The two words of a name in their order, so that either order of typing is one name."""
    return F.array_join(F.sort_array(F.array(x, y)), " ")


def _words(key: Column) -> tuple[Column, Column]:
    return F.substring_index(key, " ", 1), F.substring_index(key, " ", -1)


def _each(df: DataFrame, *rows: Column) -> DataFrame:
    """Several rows of each row, in one pass."""
    return df.select(F.explode(F.array(*rows)).alias("e")).select("e.*")


def learned(rows: DataFrame) -> DataFrame:
    """(word, long): short forms of given names that the rows themselves show.

    Two names of one mailbox that share a word may be two forms of one.  Words
    that are seen so with ``FAMILIES`` or more shared words are, if ``SHARE`` of
    all that the rarer word is seen with is the other: a slip in typing is made
    once, and people who share a mailbox and a family name have names of all
    kinds, but a short form has one long form.
    """
    view = lambda family, word: F.struct("handle", F.col(family).alias("family"), F.col(word).alias("word"))
    views = _each(rows.filter("first is not null and not organisation"), view("last", "first"), view("first", "last")).distinct()
    bearers = views.groupBy("word").agg(F.count_distinct("family").alias("bearers"))
    forms = views.filter("not startswith(handle, '@')")
    met = (
        forms.join(forms.withColumnRenamed("word", "long"), ["handle", "family"])
        .filter("word != long")
        .groupBy("word", "long")
        .agg(F.count_distinct("family").alias("families"))
        .join(bearers.select(F.col("word").alias("long"), F.col("bearers").alias("long_bearers")), "long")
    )
    best = F.max(F.struct("families", "long_bearers", "long")).alias("b")
    found = met.groupBy("word").agg(best, F.sum("families").alias("all")).select("word", "b.*", "all").join(bearers, "word")
    return found.filter((F.col("families") >= FAMILIES) & (F.col("families") >= SHARE * F.col("all")) & (F.col("long_bearers") > F.col("bearers"))).select("word", "long")


def long_forms(rows: DataFrame, forms: DataFrame) -> DataFrame:
    """Rows, numbered by ``no``, with learned short forms in ``first``, ``last`` and ``single`` made long."""
    words = F.explode(F.array_distinct(F.array_compact(F.array("first", "last", "single")))).alias("word")
    changed = rows.filter("not organisation").select("no", words).join(forms, "word").groupBy("no").agg(F.map_from_entries(F.collect_list(F.struct("word", "long"))).alias("of"))
    long = lambda c: F.coalesce(F.element_at("of", F.col(c)), F.col(c)).alias(c)
    return rows.join(changed, "no", "left").select(*(long(c) if c in ("first", "last", "single") else F.col(c) for c in rows.columns if c != "no"))


def _variant_keys(keys: DataFrame) -> DataFrame:
    """(key, other, distance, slip): different names of which one word is equal and the other a variant.

    Either word may be the equal one, in either order.  ``slip``: the word of
    ``key`` that differs is borne by few names, and that of ``other`` by many,
    as with a given name and a slip in typing it.
    """
    views = _each(keys, F.struct(F.col("first").alias("block"), F.col("last").alias("rest")), F.struct(F.col("last").alias("block"), F.col("first").alias("rest")))
    bearers = views.groupBy(F.col("rest").alias("word")).agg(F.count("*").alias("c"))
    both = (
        name_pairs(views, "block", "rest")
        .join(bearers.select(F.col("word").alias("a"), F.col("c").alias("ca")), "a")
        .join(bearers.select(F.col("word").alias("b"), F.col("c").alias("cb")), "b")
    )

    def way(x: str, y: str) -> Column:
        slip = (F.col("c" + x) <= FEW) & (F.col("c" + y) >= MANY * F.col("c" + x))
        return F.struct(_key(F.col("block"), F.col(x)).alias("key"), _key(F.col("block"), F.col(y)).alias("other"), "distance", slip.alias("slip"))

    return _each(both, way("a", "b"), way("b", "a")).groupBy("key", "other").agg(F.min("distance").alias("distance"), F.bool_or("slip").alias("slip"))


def _close(x: Column, y: Column) -> Column:
    """Whether two words differ, but by no more than the edits allowed."""
    least = F.least(F.length(x), F.length(y))
    return F.levenshtein(x, y, 2).between(1, F.when(least >= 5, 2).when(least >= 4, 1).otherwise(0))


def _mailbox_variants(used: DataFrame) -> DataFrame:
    """(handle, key, other): names used with one handle of which both words are variants, in either order."""
    words = used.select("handle", "key", "first", "last", F.explode(F.array("first", "last")).alias("word"))
    side = lambda n, end: words.select(F.col("handle").alias("block"), F.col("word").alias(n), *(F.col(c).alias(c + end) for c in ("key", "first", "last")))
    met = name_pairs(words, "handle", "word").join(side("a", "_x"), ["block", "a"]).join(side("b", "_y"), ["block", "b"])
    straight = _close(F.col("first_x"), F.col("first_y")) & _close(F.col("last_x"), F.col("last_y"))
    crossed = _close(F.col("first_x"), F.col("last_y")) & _close(F.col("last_x"), F.col("first_y"))
    found = met.filter((straight | crossed) & (F.col("key_x") != F.col("key_y")))
    way = lambda x, y: F.struct(F.col("block").alias("handle"), F.col("key_" + x).alias("key"), F.col("key_" + y).alias("other"))
    return _each(found, way("x", "y"), way("y", "x"))


def _shortened(used: DataFrame) -> DataFrame:
    """(handle, key, other): names used with one handle of which one word is equal and the other, of two letters at least, begins the other."""
    view = lambda family, word: F.struct("handle", "key", F.col(family).alias("family"), F.col(word).alias("word"))
    views = _each(used, view("first", "last"), view("last", "first"))
    met = views.join(views.select("handle", "family", F.col("key").alias("other"), F.col("word").alias("whole")), ["handle", "family"])
    found = met.filter((F.length("word") >= 2) & (F.col("word") != F.col("whole")) & F.startswith("whole", F.col("word")) & (F.col("key") != F.col("other")))
    return _each(found, F.struct("handle", "key", "other"), F.struct("handle", F.col("other").alias("key"), F.col("key").alias("other")))


def link(df: DataFrame, key: str, name: str, email: str) -> DataFrame:
    """(id, entity): the entity of each identity, named by the least node of its component.

    Identities that nothing ties to another are entities of their own.  Rows
    without an id are left out, as are null and empty names and addresses as
    evidence; repeated ids are one identity with several spellings.
    """
    typed = parsed(df.filter(F.col(key).isNotNull()).select(key, name, email).distinct(), key, name, email)
    typed = materialize(typed.withColumn("no", F.monotonically_increasing_id()), "typed")
    rows = (
        long_forms(typed, materialize(learned(typed), "forms"))
        .withColumn("key", F.when(F.col("first").isNotNull(), _key(F.col("first"), F.col("last"))))
        # a role's mailbox names an organisation, and nobody else
        .withColumn("handle", F.when(F.col("organisation") | ~F.startswith("handle", F.lit("@")), F.col("handle")))
        .withColumn("row", F.xxhash64("id", "first", "last", "single", "initials", "handle"))
    )
    rows = materialize(rows, "identities")
    named = rows.filter("key is not null")
    first, last = _words(F.col("key"))
    keys = materialize(named.groupBy("key").agg(F.count("*").alias("times")).withColumns({"first": first, "last": last}), "names")
    variants = materialize(_variant_keys(keys), "variants")

    # The main name of a handle: one that the handle is derived from, the one with most variants, and the most used.
    used = named.filter("handle is not null").groupBy("handle", "key").agg(F.count("*").alias("n")).join(keys.select("key", "first", "last", "times"), "key")
    used = materialize(used, "used")
    twice = materialize(_mailbox_variants(used).unionByName(_shortened(used)).distinct(), "twice")
    beside = used.select("handle", F.col("key").alias("other"), "n")
    together = (
        beside.join(variants.select("key", "other"), "other")
        .join(used.select("handle", "key"), ["handle", "key"], "left_semi")
        .select("handle", "key", "other", "n")
        .unionByName(beside.join(twice, ["handle", "other"]).select("handle", "key", "other", "n"))
        .dropDuplicates(["handle", "key", "other"])  # a pair may be both
    )
    together = materialize(together, "together")
    support = together.groupBy("handle", "key").agg(F.sum("n").alias("support"))
    rank = F.struct(
        derived(_letters(F.col("handle")), F.col("first"), F.col("last")).alias("d"), (F.coalesce("support", F.lit(0)) + F.col("n")).alias("s"), "n", "times", "key"
    )
    main = used.join(support, ["handle", "key"], "left").groupBy("handle").agg(F.max(rank)["key"].alias("main"))
    near = together.select("handle", "key", F.col("other").alias("main"), F.lit(True).alias("near"))
    ma, mb = _words(F.col("main"))
    at = rows.filter("handle is not null").join(main, "handle").join(near, ["handle", "key", "main"], "left").withColumns({"ma": ma, "mb": mb})
    a, b, single, initials = F.col("ma"), F.col("mb"), F.col("single"), F.col("initials")
    one_initial = F.length("initials") > 0
    weak = F.col("key").isNull() & any_of(
        # one word, and initials of the other
        one_initial & ((single == a) & F.startswith(b, F.substring("initials", 1, 1)) | (single == b) & F.startswith(a, F.substring("initials", 1, 1))),
        one_initial & (F.levenshtein(single, a, 2) >= 0) & (F.length("single") >= 6) & F.startswith(b, F.substring("initials", 1, 1)),
        one_initial & (F.levenshtein(single, b, 2) >= 0) & (F.length("single") >= 6) & F.startswith(a, F.substring("initials", 1, 1)),
        ~one_initial & ((single == a) | (single == b)),
        # a login in place of a name
        ~one_initial & derived(_letters(single), a, b),
        ~one_initial & (F.regexp_replace(single, "[^a-z0-9]", "") == F.col("handle")),
        # no name at all, in a mailbox that the name has given its handle
        single.isNull() & ~one_initial & derived(_letters(F.col("handle")), a, b),
    )
    fits = any_of(F.col("key") == F.col("main"), F.col("near"), weak)
    # written before it is used, else its long conditions are compiled wherever it is
    held = materialize(at.select("id", "row", "key", "handle", "main", fits.alias("fits")), "held")
    held = held.withColumn("as", F.when(F.col("fits"), F.col("main")).otherwise(F.col("key"))).filter("as is not null")
    mailbox_ties = held.select("id", F.concat_ws("|", F.lit("h"), "handle", "as").alias("node"))

    # Handles used under one name only, and how they go with it.
    shared = held.groupBy("handle").agg(F.count_if(~F.col("fits")).alias("others")).filter("others > 0").select("handle")
    own = held.filter("fits").select("handle", "main").distinct().join(shared, "handle", "left_anti")
    own = own.withColumns({"ma": ma, "mb": mb})
    head = F.substring("handle", 2, 1 << 20)
    belongs = F.when(F.startswith("handle", F.lit("@")), any_of(head == a, head == b, F.levenshtein(head, a, 2) >= 0, F.levenshtein(head, b, 2) >= 0)).otherwise(
        derived(_letters(F.col("handle")), a, b)
    )
    known = own.withColumn("belongs", belongs).groupBy("main").agg(F.count_if("belongs").alias("proper"), F.count_if(~F.col("belongs")).alias("foreign"))
    state = (
        keys.join(known.withColumnRenamed("main", "key"), "key", "left")
        .withColumns({"proper": F.coalesce("proper", F.lit(0)), "foreign": F.coalesce("foreign", F.lit(0))})
        .withColumn("clear", F.col("foreign") + (F.col("proper") > 0).cast("int") <= 1)
        .withColumn("settled", (F.col("proper") > 0) | (F.col("times") > 1) & (F.col("foreign") > 0))
    )
    state = materialize(state.select("key", "first", "last", "proper", "clear", "settled"), "state")

    # Name ties: the same name, if it is clear.
    clear = state.filter("clear").select("key")
    node = F.concat_ws("|", F.lit("n"), "key")
    name_ties = named.join(clear, "key", "left_semi").select("id", node.alias("node"))

    # A variant that is not itself a settled name goes with the one settled name next to it.
    target = state.filter("clear and settled").select(F.col("key").alias("other"), F.col("first").alias("ma"), F.col("last").alias("mb"))
    loose = named.join(state.select("key", (F.expr("not settled or proper = 0")).alias("open")), "key")
    nearest = Window.partitionBy("row").orderBy("distance")
    foreign = F.col("handle").isNotNull() & F.col("shared").isNull()
    close = (
        loose.join(variants, "key")
        .filter("open or (slip and handle is not null)")
        .join(target, "other")
        .join(shared.withColumn("shared", F.lit(True)), "handle", "left")
        .filter(~foreign | derived(_letters(F.col("handle")), a, b) | (F.col("handle") == F.concat(F.lit("@"), a)) | (F.col("handle") == F.concat(F.lit("@"), b)))
        .withColumn("place", F.rank().over(nearest))
        .filter("place = 1")
        .groupBy("id", "row")
        .agg(F.min("other").alias("key"), F.count_distinct("other").alias("c"))
        .filter("c = 1")
    )
    variant_ties = materialize(close.select("id", node.alias("node")), "close")

    # Weak names by a handle that is derived from one settled name.
    unnamed = rows.filter("key is null and (single is not null or initials != '')")
    goes = any_of(
        single.isNull(),
        ~one_initial & ((single == a) | (single == b) | derived(_letters(single), a, b) | (F.regexp_replace(single, "[^a-z0-9]", "") == F.col("handle"))),
        one_initial & ((single == a) & F.startswith(b, F.substring("initials", 1, 1)) | (single == b) & F.startswith(a, F.substring("initials", 1, 1))),
        one_initial & (F.length("single") >= 6) & ((F.levenshtein(single, a, 2) >= 0) | (F.levenshtein(single, b, 2) >= 0)),
    )
    letters = target.select("other", "ma", "mb", F.explode(handles_of(F.col("ma"), F.col("mb"))).alias("letters"))
    by_handle = (
        # handles are many times larger than the names they are made of, by whose size they would be broadcast
        unnamed.filter("handle is not null").withColumn("letters", _letters(F.col("handle"))).join(letters.hint("merge"), "letters").filter(goes)
    )
    # Without a handle, by a word and an initial.
    by_word = (
        unnamed.filter("handle is null and single is not null and initials != ''")
        .join(target.select("other", "ma", "mb", F.explode(F.array("ma", "mb")).alias("single")), "single")
        .filter((single == a) & F.startswith(b, F.substring("initials", 1, 1)) | (single == b) & F.startswith(a, F.substring("initials", 1, 1)))
    )
    weak_ties = (
        by_handle.select("id", "row", "other")
        .unionByName(by_word.select("id", "row", "other"))
        .groupBy("id", "row")
        .agg(F.min("other").alias("key"), F.count_distinct("other").alias("c"))
        .filter("c = 1")
        .select("id", node.alias("node"))
    )
    ties = mailbox_ties.unionByName(name_ties).unionByName(variant_ties).unionByName(weak_ties).unionByName(rows.select("id", F.lit(None).cast("string").alias("node")))

    # An identity's ties link its nodes, and many identities link the same ones; it goes with the least of its nodes, or alone.
    me = F.concat_ws("|", F.lit("i"), F.col("id").cast("string"))
    top = F.min("node").over(Window.partitionBy("id").orderBy(F.asc_nulls_last("node")))
    ties = materialize(ties.withColumn("top", F.coalesce(top, me)), "ties")
    found = components(ties.select(F.col("top").alias("a"), F.col("node").alias("b")))
    tied = ties.select("id", F.col("top").alias("node")).distinct().join(found, "node", "left").select("id", F.coalesce("component", "node").alias("component"))
    tied = materialize(tied, "tied")
    least = tied.groupBy("component").agg(F.least("component", F.min(me)).alias("entity"))
    return tied.join(least, "component").select(F.col("id").alias(key), "entity")


def pairs(linked: DataFrame, key: str) -> DataFrame:
    """(key_a, key_b): all pairs of identities of an entity, the lesser first."""
    x = linked.select(F.col(key).alias(f"{key}_a"), "entity")
    y = linked.select(F.col(key).alias(f"{key}_b"), "entity")
    return x.join(y, "entity").filter(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
