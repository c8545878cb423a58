"""Joins of code symbols: as-of, range, first match, and the call graph.

The as-of join is one window over each document's occurrences; the range join ranks candidates in
one window over each chunk. Neither collects a document or makes pairs of occurrences.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import symbols as X


def asof_backward(df: DataFrame, by: list[str], order: list[str], is_source: Column, value: Column, name: str) -> DataFrame:
    """Add ``name``: ``value`` of the last source row at or before each row, in ``order`` within ``by``.

    Rows that agree in the first of ``order`` see each other, whatever the rest of it; of sources
    that agree there, the last counts.
    """
    key = order[0]
    seen = F.max(F.when(is_source, F.struct(*order, value.alias("__v")))).over(Window.partitionBy(*by).orderBy(key).rangeBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, seen["__v"])


def enclosing_definitions(occurrences: DataFrame) -> DataFrame:
    """References with the definition that encloses them: the last at or before their line in the document."""
    keyed = occurrences.withColumn("is_def", F.col("symbol_roles").bitwiseAND(1) == 1)
    known = asof_backward(keyed, ["index_ord", "doc_ord"], ["start", "idx"], F.col("is_def"), F.col("symbol"), "caller")
    return known.where(~F.col("is_def") & F.col("caller").isNotNull())


def definitions(symbols: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Symbols with start and end lines of their last definition in this or a later document than their declaration.

    Of repeated declarations of a symbol the last counts; local symbols are kept by document.
    """
    scope = F.when(F.col("symbol").startswith("local "), F.col("doc_ord")).otherwise(F.lit(-1))
    last = Window.partitionBy("index_ord", "scope", "symbol").orderBy(F.desc("doc_ord"), F.desc("ord"))
    declared = symbols.withColumn("scope", scope).withColumn("__k", F.row_number().over(last))
    first = symbols.withColumn("scope", scope).groupBy("index_ord", "scope", "symbol").agg(F.min(F.struct("doc_ord", "ord")).alias("at"))
    declared = declared.where("__k = 1").drop("__k").join(first, ["index_ord", "scope", "symbol"])
    defined = occurrences.where(F.col("symbol_roles").bitwiseAND(1) == 1).withColumn("scope", scope)
    defined = defined.select("index_ord", "scope", "symbol", F.col("doc_ord").alias("def_doc"), "idx", "start", "end")
    known = declared.join(defined, ["index_ord", "scope", "symbol"], "left").where(F.col("def_doc").isNull() | (F.col("def_doc") >= F.col("at.doc_ord")))
    spans = known.groupBy("index_ord", "scope", "symbol").agg(F.max(F.struct("def_doc", "idx", "start", "end")).alias("d"))
    return declared.drop("at").join(spans, ["index_ord", "scope", "symbol"], "left").withColumns({"start": F.col("d.start"), "end": F.col("d.end")}).drop("d")


def call_edges(occurrences: DataFrame, symbols: DataFrame) -> DataFrame:
    """(index_ord, caller, callee, pos): one row an edge, at its first occurrence; ends must be declared, no self edges."""
    found = enclosing_definitions(occurrences).where("symbol <> '' and symbol <> caller")
    edges = found.groupBy("index_ord", "caller", F.col("symbol").alias("callee")).agg(F.min(F.struct("doc_ord", "idx")).alias("pos"))
    names = symbols.select("index_ord", "symbol").distinct()
    for side in ("caller", "callee"):
        edges = edges.join(names.withColumnRenamed("symbol", side), ["index_ord", side], "left_semi")
    return edges.select("index_ord", "caller", "callee", "pos")


def relations(edges: DataFrame, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(callees by caller, callers by callee): the first ``most`` in order of appearance, comma-joined."""

    def side(key: str, other: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("index_ord", key).orderBy("pos", other))
        first = edges.withColumn("k", rank).where(F.col("k") <= most)
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", other))), lambda x: x[other]), ", ")
        return first.groupBy("index_ord", F.col(key).alias("symbol")).agg(listed.alias(other + "s"))

    return side("caller", "callee"), side("callee", "caller")


def lookup(chunks: DataFrame, symbols: DataFrame, key: str = "id", one_based: bool = True, strict: bool = True) -> DataFrame:
    """Add the symbol of each chunk (left join): within its lines the earliest, else the closest before, else after.

    Chunks have ``key``, file_path, start_line and end_line; symbols index_ord, ord, relative_path,
    symbol and start (from 0; chunk lines count from 1 and are brought to it unless ``one_based`` is
    False). Paths match without case: a file's path ends with the symbol's path, by whole segments,
    or, unless ``strict``, either ends with the other's file name. The first index with a match wins.

    Chunks and symbols of one path are merged by line, and two running windows give each chunk the
    symbols next to it, so the work is linear in a file, not chunks times symbols.
    """
    shift = 1 if one_based else 0
    extra = [x for x in ("display_name", "kind", "documentation", "enclosing_symbol") if x in symbols.columns]
    doc_ord = F.col("doc_ord") if "doc_ord" in symbols.columns else F.lit(0)
    fields = ["symbol", "index_ord", "ord", *extra]
    s = symbols.where("start is not null").select(X.comparable_path(F.col("relative_path")).alias("__rel"), "start", doc_ord.alias("__doc"), *fields)
    c = chunks.select(key, X.comparable_path(F.col("file_path")).alias("__path"), (F.col("start_line") - shift).alias("__line"), (F.col("end_line") - shift).alias("__end"), (F.col("end_line") > 0).alias("__ends"))
    paths = s.select("index_ord", "__rel").distinct()
    if strict:
        parts = F.filter(F.split("__path", "/"), lambda x: x != "")
        tails = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), lambda k: F.array_join(F.slice(parts, k, F.lit(1 << 20)), "/"))
        placed = c.withColumn("__rel", F.explode(tails)).join(paths, "__rel")
    else:
        # of paths that match one file name ends with the other, so each is looked up among the other's endings
        ends = lambda n: F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length(n), F.lit(1))), lambda k: n.substr(k, F.length(n))))
        own = c.select("__path").distinct().withColumn("__name", F.substring_index("__path", "/", -1))
        named = paths.withColumn("__base", F.substring_index("__rel", "/", -1))
        both = own.withColumn("__end", ends(F.col("__name"))).join(named.withColumnRenamed("__base", "__end"), "__end")
        both = both.unionByName(named.withColumn("__end", ends(F.col("__base"))).drop("__base").join(own.withColumn("__end", F.col("__name")), "__end"))
        matched = both.where(F.col("__path").endswith(F.col("__rel")) | F.col("__rel").endswith(F.col("__name"))).select("__path", "index_ord", "__rel").distinct()
        placed = c.join(matched, "__path")
    rest = F.struct(*[F.col(x) for x in fields])
    here = s.select("index_ord", "__rel", F.col("start").cast("int").alias("__at"), F.struct("start", F.col("__doc").alias("d"), F.col("ord").alias("o"), rest.alias("r")).alias("__next"), F.struct("start", (-F.col("__doc")).alias("d"), (-F.col("ord")).alias("o"), rest.alias("r")).alias("__last"))
    both = here.unionByName(placed.select("index_ord", "__rel", F.col("__line").cast("int").alias("__at"), key, "__line", "__end", "__ends"), allowMissingColumns=True)
    by = Window.partitionBy("index_ord", "__rel")
    upto = (Window.unboundedPreceding, 0)
    # documentation and the like are carried along but never decide, as ord differs
    seen = both.withColumns({"__next": F.min_by("__next", F.when(F.col("__next").isNotNull(), F.struct("__next.start", "__next.d", "__next.o"))).over(by.orderBy(F.desc("__at")).rangeBetween(*upto)), "__last": F.max_by("__last", F.when(F.col("__last").isNotNull(), F.struct("__last.start", "__last.d", "__last.o"))).over(by.orderBy("__at").rangeBetween(*upto))})
    asked = seen.where("__line is not null")
    inside = F.col("__ends") & (F.col("__next.start") <= F.col("__end"))
    way = F.when(inside, 1).when(F.col("__last").isNotNull(), 2).otherwise(3)
    last = F.struct(F.col("__last.start").alias("start"), (-F.col("__last.d")).alias("d"), (-F.col("__last.o")).alias("o"), F.col("__last.r").alias("r"))
    found = asked.withColumns({"__way": way, "__hit": F.when(way == 2, last).otherwise(F.col("__next"))}).where("__hit is not null")
    distance = F.when(F.col("__way") == 2, -F.col("__hit.start")).otherwise(F.col("__hit.start"))
    best = found.groupBy(key).agg(F.min_by("__hit.r", F.struct("index_ord", "__way", distance, "__hit.d", "__hit.o")).alias("__r"))
    return chunks.join(best.select(key, "__r.*"), key, "left")


def enriched(chunks: DataFrame, symbols: DataFrame, occurrences: DataFrame, legacy_kinds: bool = False, one_based: bool = True, strict: bool = True) -> DataFrame:
    """Code chunks with the columns of their symbol: name, kind, enclosing, documentation, callers, callees."""
    known = definitions(symbols, occurrences)
    callees, callers = relations(call_edges(occurrences, symbols))
    found = lookup(chunks.where("chunk_type = 'code'").select("id", "file_path", "start_line", "end_line"), known, "id", one_based, strict)
    found = found.join(callees, ["index_ord", "symbol"], "left").join(callers, ["index_ord", "symbol"], "left")
    label = X.kind_label(F.col("kind"), legacy_kinds)
    named = found.where("symbol is not null").select(
        "id",
        "symbol",
        F.when(F.col("display_name") != "", F.col("display_name")).otherwise(X.display_name(F.col("symbol"))).alias("display_name"),
        F.when(F.col("kind") > 0, label).otherwise(X.inferred_kind(F.col("symbol"))).alias("kind"),
        F.col("enclosing_symbol").alias("enclosing"),
        F.array_join("documentation", "\n").alias("documentation"),
        "callers",
        "callees",
    )
    return chunks.drop(*[c for c in named.columns if c != "id"]).join(named, "id", "left")
