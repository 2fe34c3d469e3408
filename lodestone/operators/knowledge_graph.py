"""Knowledge files as a typed graph, in one pass over the files.

A file gives a document node; its question a question node and up to ten concept nodes; its name a header node and component nodes. The six kinds
of edges are has_question, mentions_concept (question to concept), contains_concept, has_header (1.2), has_component (1.0 and 0.1 more for each place)
and contains_component (header to component); all others weigh 1.0. Files are expanded once into arrays of nodes and edges, which are written;
nodes of one id are merged, and the first of equal edges stays.

Defined cases: a file without a question has no question or concepts; an empty part of a name is a component too, an empty header is none; null names
and questions are empty; rows that repeat a file add nothing; concepts of less than three characters are left out; no files give an empty graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.concepts import concepts
from lodestone.functions.rewrite import rewritten
from lodestone.functions.text import cut, node_id, script_of
from lodestone.sources.tables import written

#: Fixed value: what a header's edge weighs.
HEADER_WEIGHT = 1.2
NAME = 200


def titled(text: Column) -> Column:
    """Every run of letters with its first letter in upper case, the rest in lower case."""
    return rewritten(text, r"\p{L}+", lambda m: F.concat(F.upper(F.left(m, F.lit(1))), F.lower(F.substring(m, F.lit(2), F.length(m)))))


def _node(kind: str, key: Column, name: Column, source: Column, aliases: Column | None = None) -> Column:
    none = F.array().cast("array<string>")
    ko = F.when(script_of(name) == "ko", name)
    return F.struct(key.alias("id"), F.lit(kind).alias("type"), name.alias("name"), ko.alias("name_ko"), (none if aliases is None else aliases).alias("aliases"), source.alias("source"))


def _edge(kind: str, source: Column, target: Column, weight: Column | float = 1.0) -> Column:
    return F.struct(source.alias("source"), target.alias("target"), F.lit(kind).alias("type"), (weight if isinstance(weight, Column) else F.lit(weight)).alias("weight"))


def expanded(files: DataFrame) -> DataFrame:
    """(ord, nodes, edges) of every file. files: (ord, stem, name, question, aliases). Ids are worked out once for a row, before nodes and edges take them."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    parts = F.transform(F.split(text("stem"), "-"), lambda p: F.trim(p))
    f = files.select("ord", text("stem").alias("stem"), text("name").alias("name"), text("question").alias("question"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.get(parts, 0).alias("header"), F.slice(parts, 2, F.size(parts)).alias("components"))
    f = f.withColumn("concepts", F.filter(concepts(F.col("question")), lambda c: F.length(c) >= 3))
    of = lambda kind, x: F.concat(F.lit(f"{kind}_"), node_id(x))
    each = lambda kind, column: F.transform(column, lambda x: F.struct(x.alias("x"), of(kind, x).alias("id")))
    f = f.withColumns({
        "doc_key": of("document", F.col("stem")), "question_key": of("question", F.col("stem")), "header_key": of("header", F.col("header")),
        "concepts": each("concept", "concepts"), "components": each("component", "components"),
    })
    doc, question, header = F.col("doc_key"), F.col("question_key"), F.col("header_key")
    asked, headed = F.col("question") != "", F.col("header") != ""
    none = lambda like: F.filter(like, lambda _: F.lit(False))

    document = F.array(_node("document", doc, F.col("name"), F.lit(""), F.col("aliases")))
    questions = F.array(_node("question", question, cut(F.col("question"), NAME), doc))
    of_concepts = F.transform("concepts", lambda c: _node("concept", c["id"], titled(c["x"]), question))
    headers = F.array(_node("header", header, titled(F.col("header")), F.lit("filename")))
    components = F.transform("components", lambda c, i: _node("component", c["id"], titled(c["x"]), F.concat(F.lit("filename "), i.cast("string"))))
    nodes = F.concat(document, F.when(asked, F.concat(questions, of_concepts)).otherwise(none(questions)), F.when(headed, headers).otherwise(none(headers)), components)

    has_question = F.array(_edge("has_question", doc, question))
    mentions = F.flatten(F.transform("concepts", lambda c: F.array(_edge("mentions_concept", question, c["id"]), _edge("contains_concept", doc, c["id"]))))
    has_header = F.array(_edge("has_header", doc, header, HEADER_WEIGHT))
    has_components = F.transform("components", lambda c, i: _edge("has_component", doc, c["id"], F.round(1.0 + 0.1 * i, 3)))
    contains = F.transform("components", lambda c: _edge("contains_component", header, c["id"]))
    edges = F.concat(F.when(asked, F.concat(has_question, mentions)).otherwise(none(has_question)), F.when(headed, F.concat(has_header, contains)).otherwise(none(has_header)), has_components)
    return f.select("ord", nodes.alias("nodes"), edges.alias("edges"))


def nodes_of(graph: DataFrame) -> DataFrame:
    """(id, type, name, name_ko, aliases, source): of nodes with one id the first name stays, aliases are united, the last source counts."""
    each = graph.select("ord", F.posexplode("nodes").alias("i", "n")).select(F.struct("ord", "i").alias("at"), "n.*")
    merged = each.groupBy("id").agg(
        F.min_by("type", "at").alias("type"), F.min_by("name", "at").alias("name"), F.min_by("name_ko", F.when(F.col("name_ko").isNotNull(), F.col("at"))).alias("name_ko"),
        F.max_by("source", "at").alias("source"),
    )
    names = each.select("id", F.explode("aliases").alias("alias")).distinct().groupBy("id").agg(F.array_sort(F.collect_list("alias")).alias("aliases"))
    return merged.join(names, "id", "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))


def edges_of(graph: DataFrame) -> DataFrame:
    """(source, target, type, weight): the first of equal edges."""
    each = graph.select("ord", F.posexplode("edges").alias("i", "e")).select(F.struct("ord", "i").alias("at"), "e.*")
    return each.groupBy("source", "target", "type").agg(F.min_by("weight", "at").alias("weight"))


def built(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all files, from one expansion."""
    graph = written(expanded(files), "graph")
    return nodes_of(graph), edges_of(graph)
