"""Knowledge graphs as tables: extraction replies, merged entities and relations, retrieval over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ragbench.functions.similarity import indel_ratio
from ragbench.functions.text import fold, name_key, one_space
from ragbench.operators.retrieval import top_k
from ragbench.operators.strings import similar_strings
from ragbench.sources.shared import written

SYNONYM_RATIO = 85
#: Weight of a neighbour, and what a prompt may hold of facts and of neighbours shown.
NEIGHBOUR_WEIGHT, MAX_FACTS, MAX_FACTS_CHARS, MAX_NEIGHBOURS = 0.5, 10, 2000, 20
#: Fixed values of the reply format: separator, end, what may stand around a line or a field, headings, names in parentheses.
SEPARATOR, END = r"<\|>", "<|FIM|>"
_EDGE = "`'\" "
_MARKER, _WRAPPED = r"^(?:\d+[.)]|[-*•>])\s*", r"^\(.*\)$"
_HEADING = r"^#{1,6}\s+\S"
_NICKNAME = r"^(.*\S)\s*\(([^()]+)\)\s*$"


def without_headings(chunk: Column) -> Column:
    """The chunk without the heading and blank lines that it begins with."""
    lines = F.split(chunk, "\n", -1)
    body = F.transform(lines, lambda x: ~x.rlike(_HEADING) & (F.btrim(x) != ""))
    first = F.array_position(body, True)
    return F.when(first == 0, "").otherwise(F.btrim(F.array_join(F.slice(lines, F.greatest(first, F.lit(1)), F.size(lines)), "\n")))


def parse_replies(replies: DataFrame) -> DataFrame:
    """Lines of extraction replies (chunk_id, reply): kind entity, relation or failed, with their fields.

    List markers, wrapping parentheses and quotes are dropped; an entity has four fields, a relation five, the
    first two after the tag not empty; blank lines and the end marker don't count.
    """
    lines = replies.select("chunk_id", F.posexplode(F.split("reply", r"\r?\n", -1)).alias("line_no", "line")).withColumn("line", F.btrim("line"))
    lines = lines.where((F.col("line") != "") & (F.col("line") != END))
    plain = F.regexp_replace("line", _MARKER, "")
    plain = F.when(plain.rlike(_WRAPPED), F.regexp_replace(plain, r"^\(|\)$", "")).otherwise(plain)
    lines = lines.withColumn("f", F.transform(F.split(plain, SEPARATOR, -1), lambda x: F.btrim(x, F.lit(_EDGE))))
    tag, full = F.lower(F.col("f")[0]), (F.get("f", F.lit(1)) != "") & (F.get("f", F.lit(2)) != "")
    kind = F.when((tag == "entidade") & (F.size("f") == 4) & full, "entity").when((tag == "relacao") & (F.size("f") == 5) & full, "relation").otherwise("failed")
    at = lambda i: F.get("f", F.lit(i))
    rows = lines.withColumn("kind", kind)
    return rows.select(
        "chunk_id", "line_no", "kind", F.when(F.col("kind") != "failed", at(1)).alias("a"), F.when(F.col("kind") == "relation", at(2)).alias("b"),
        F.when(F.col("kind") == "entity", fold(at(2))).alias("type"), F.when(F.col("kind") == "relation", at(3)).alias("keywords"),
        F.when(F.col("kind") == "entity", at(3)).when(F.col("kind") == "relation", at(4)).alias("description"),
    )


def extraction_key(extractor: Column, version: Column, text: Column) -> Column:
    return F.sha2(F.concat_ws("\u0000", version, extractor, text), 256)


def missing_extractions(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Chunks with a body whose key the cache lacks."""
    return chunks.where(F.btrim("body") != "").join(cache.select("key").hint("merge"), "key", "left_anti")


def to_cache(chunks: DataFrame, replies: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, lines) rows to append to the cache: parsed replies of chunks (chunk_id, key, body) that it lacks.

    A chunk without a body has an empty extraction; one whose model call failed (no reply, or null) is not cached. Chunks of equal key count once.
    """
    empty = F.coalesce(F.btrim("body") == "", F.lit(True))
    known = replies.where("reply is not null").select("chunk_id", "reply")
    got = chunks.join(known.hint("merge"), "chunk_id", "left").where(empty | F.col("reply").isNotNull())
    fresh = got.join(cache.select("key").hint("merge"), "key", "left_anti")
    one = fresh.groupBy("key").agg(F.min_by(F.struct("chunk_id", F.when(empty, "").otherwise(F.col("reply")).alias("reply")), "chunk_id").alias("r")).select("key", "r.*")
    parsed = parse_replies(one.select("chunk_id", "reply"))
    lines = parsed.groupBy("chunk_id").agg(F.array_sort(F.collect_list(F.struct("line_no", "kind", "a", "b", "type", "keywords", "description"))).alias("lines"))
    none = F.array().cast(lines.schema["lines"].dataType)
    return one.join(lines.hint("merge"), "chunk_id", "left").select("key", F.coalesce("lines", none).alias("lines"))


def nicknames(name: Column) -> tuple[Column, Column]:
    """(name without trailing parentheses, aliases in order), up to three of them."""
    aliases = F.array().cast("array<string>")
    for _ in range(3):
        hit = name.rlike(_NICKNAME)
        aliases = F.when(hit, F.concat(F.array(F.btrim(F.regexp_extract(name, _NICKNAME, 2))), aliases)).otherwise(aliases)
        name = F.when(hit, F.regexp_extract(name, _NICKNAME, 1)).otherwise(name)
    return one_space(name), aliases


def hub(entities: DataFrame) -> DataFrame:
    """At most one row: the folded name in most chunks (two at least)."""
    n = entities.groupBy(fold(name_key(F.col("base"))).alias("hub")).agg(F.countDistinct("chunk_id").alias("n"))
    return n.where("n >= 2").orderBy(F.desc("n"), "hub").limit(1).select("hub")


def strip_hub(name: Column, hub_name: Column) -> Column:
    """The name without a trailing " em <hub>" or ", <hub>"; never the whole name."""
    words = F.split(name, " ")
    k = F.size(F.split(hub_name, " "))
    ends = (F.size(words) > k) & (fold(F.array_join(F.slice(words, F.greatest(F.size(words) - k + 1, F.lit(1)), k), " ")) == hub_name)
    head = F.slice(words, 1, F.greatest(F.size(words) - k, F.lit(0)))
    last = F.element_at(head, -1)
    cut = F.array_join(F.slice(head, 1, F.greatest(F.size(head) - 1, F.lit(0))), " ")
    joined = F.when(last.rlike(r"^.+,$"), F.regexp_replace(F.array_join(head, " "), ",$", "")).when(fold(last).isin("em", ",") & (F.size(head) > 1), cut).otherwise(name)
    return F.when(hub_name.isNotNull() & ends, joined).otherwise(name)


def _ordered(value: str, order: str = "pos") -> Column:
    """Distinct non-empty texts in order, as one."""
    return F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(value) != "", F.struct(order, value)))), lambda x: x[value])), " ")


def merge_entities(lines: DataFrame) -> DataFrame:
    """Entities (key, name, type, description, chunk_ids, aliases) from parsed lines.

    Names lose nicknames and the hub; an alias that one entity alone claims stands for it. The type is the most
    frequent one (of equals, the first seen).
    """
    base, aliases = nicknames(F.col("a"))
    e = lines.where("kind = 'entity'").select("chunk_id", F.struct("chunk_id", "line_no").alias("pos"), base.alias("base"), aliases.alias("aliases"), "type", "description")
    e = written(e, "entities")
    top = hub(e)
    e = e.crossJoin(F.broadcast(top.agg(F.max("hub").alias("hub"))))  # one row
    e = e.withColumn("base", strip_hub(F.col("base"), F.col("hub"))).withColumn("own", name_key(F.col("base")))
    claims = e.select("own", F.explode("aliases").alias("alias")).select("own", name_key(F.col("alias")).alias("alias")).where("alias <> own")
    single = claims.groupBy("alias").agg(F.countDistinct("own").alias("n"), F.min("own").alias("target")).where("n = 1").select("alias", "target")
    e = written(e.join(single.hint("merge"), e["own"] == single["alias"], "left").withColumn("key", F.coalesce("target", "own")), "resolved")
    types = e.groupBy("key", "type").agg(F.count("*").alias("n"), F.min("pos").alias("p")).groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "p", "type"))["type"].alias("type"))
    merged = e.groupBy("key").agg(
        F.coalesce(F.min(F.when(F.col("own") == F.col("key"), F.struct("pos", "base")))["base"], F.min(F.struct("pos", "base"))["base"]).alias("name"),
        _ordered("description").alias("description"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("aliases")))).alias("aliases"),
    )
    return merged.join(types.hint("merge"), "key")


def merge_relations(lines: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations by directed pair of keys, entities promoted to type outro because only relations name them).

    A relation of an entity with itself is dropped, as is one whose unknown end begins like a number or a price.
    """
    entities = written(entities.select("key", "aliases"), "names")
    known = entities.select("key")
    names = known.select("key", F.col("key").alias("spelling")).unionByName(entities.select("key", F.explode("aliases").alias("x")).select("key", name_key(F.col("x")).alias("spelling"))).dropDuplicates(["spelling"])
    r = lines.where("kind = 'relation'").withColumn("pos", F.struct("chunk_id", "line_no"))
    for side, out in (("a", "source"), ("b", "target")):
        plain = name_key(nicknames(F.col(side))[0])
        r = r.withColumn("_s", plain).join(names.select(F.col("key").alias("_k"), F.col("spelling").alias("_s")).hint("merge"), "_s", "left")
        r = r.withColumn(out, F.coalesce("_k", "_s")).withColumn(f"{out}_new", F.col("_k").isNull()).drop("_s", "_k")
    value = lambda c: F.col(c).rlike(r"^\s*(\d|R\$|\$|€)")
    r = written(r.where((F.col("source") != F.col("target")) & ~(F.col("source_new") & value("a")) & ~(F.col("target_new") & value("b"))), "relations")
    relations = r.groupBy("source", "target").agg(_ordered("keywords").alias("keywords"), _ordered("description").alias("description"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    new = r.where("source_new").select(F.col("source").alias("key"), F.col("a").alias("name"), "chunk_id").unionByName(r.where("target_new").select(F.col("target").alias("key"), F.col("b").alias("name"), "chunk_id"))
    promoted = new.groupBy("key").agg(F.min("name").alias("name"), F.lit("outro").alias("type"), F.array_sort(F.collect_set("chunk_id")).alias("chunk_ids"))
    return relations, promoted


def synonyms(entities: DataFrame, least: float = SYNONYM_RATIO) -> DataFrame:
    """(key, other, weight), both ways, for folded names with an Indel ratio of ``least`` or more.

    Names are joined by ``similar_strings``, which is exact; entities of one folded name are compared once.
    """
    names = written(entities.select("key", fold(F.col("name")).alias("text")).where("text <> ''"), "names")
    close = similar_strings(names.select(F.col("text").alias("id"), "text").distinct(), least=least)
    # Both ways from one pass over the pairs: a union would look for them twice.
    both = (F.struct(F.col(one).alias("left_id"), F.col(two).alias("right_id"), "ratio") for one, two in (("left_id", "right_id"), ("right_id", "left_id")))
    ways = close.select(F.inline(F.array(*both)))
    ways = written(ways.unionByName(names.groupBy("text").count().where("count > 1").select(F.col("text").alias("left_id"), F.col("text").alias("right_id"), F.lit(100.0).alias("ratio"))), "close")
    one, two = names.select("key", F.col("text").alias("left_id")), names.select(F.col("key").alias("other"), F.col("text").alias("right_id"))
    return ways.join(one, "left_id").join(two, "right_id").where("key <> other").select("key", "other", F.round(F.col("ratio") / 100, 4).alias("weight"))


def build_stats(lines: DataFrame, replies: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: entities, relations, chunks, lines, failed lines, failed chunks, and an error if every chunk failed.

    A chunk has failed if its model call did: its reply is null. Its lines, of which there are none, count nowhere.
    """
    s = lines.agg(F.count("*").alias("lines"), F.count_if(F.col("kind") == "failed").alias("failed_lines"))
    c = replies.agg(F.count("*").alias("chunks"), F.count_if(F.col("reply").isNull()).alias("failed_chunks"))
    counts = entities.agg(F.count("*").alias("entities")).crossJoin(relations.agg(F.count("*").alias("relations"))).crossJoin(c).crossJoin(s)  # one row each
    error = F.when((F.col("chunks") > 0) & (F.col("failed_chunks") == F.col("chunks")), "the extractor failed on every chunk")
    return counts.withColumn("error", error)


def specificity(entities: DataFrame, n_chunks: int) -> DataFrame:
    """ln((N+1)/n) / ln(N+1) with N not below n, n the entity's chunks."""
    n = F.size("chunk_ids")
    big = F.greatest(F.lit(n_chunks), n)
    return entities.withColumn("specificity", F.when(n > 0, F.log((big + 1) / n) / F.log(big + 1)).otherwise(0.0))


def expand(seeds: DataFrame, relations: DataFrame, links: DataFrame, spec: DataFrame) -> DataFrame:
    """Node scores by question (qid, key, score): seeds keep theirs, neighbours get half, synonyms the weight's share, each times their specificity; the greatest counts.

    Neighbours are read from the seeds alone, so the order does not matter. ``seeds`` has qid, key, score (already
    weighted).
    """
    both = relations.select("source", "target").unionByName(relations.select(F.col("target").alias("source"), F.col("source").alias("target")))  # a pair related both ways comes twice, which the greatest score doesn't mind
    near = seeds.join(both, seeds["key"] == both["source"]).select("qid", F.col("target").alias("key"), (F.col("score") * NEIGHBOUR_WEIGHT).alias("score"))
    alike = seeds.join(links, "key").select("qid", F.col("other").alias("key"), (F.col("score") * F.col("weight")).alias("score"))
    reached = near.unionByName(alike).join(spec.select("key", "specificity"), "key", "left").select("qid", "key", (F.col("score") * F.coalesce("specificity", F.lit(0.0))).alias("score"))
    return seeds.select("qid", "key", "score").unionByName(reached).groupBy("qid", "key").agg(F.max("score").alias("score"))


def score_chunks(nodes: DataFrame, mentions: DataFrame, k: int = 5, relations: DataFrame | None = None, existing: DataFrame | None = None) -> DataFrame:
    """The k chunks with the greatest sum of their nodes' scores, by (-score, id).

    ``nodes`` are (qid, key, score), ``mentions`` (key, chunk_id). ``relations``, matched ones with their weighted score
    (qid, chunk_ids, score), add to the chunks that name them; only ``existing`` chunks count, if given.
    """
    parts = nodes.hint("merge").join(mentions.select("key", "chunk_id").hint("merge"), "key").select("qid", "chunk_id", "score")
    if relations is not None:
        parts = parts.unionByName(relations.select("qid", F.explode("chunk_ids").alias("chunk_id"), "score"))
    by_chunk = parts.groupBy("qid", "chunk_id").agg(F.sum("score").alias("score")).where("score > 0")
    if existing is not None:
        by_chunk = by_chunk.hint("merge").join(existing.select("chunk_id").distinct(), "chunk_id", "left_semi")
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc(F.round("score", 9)), "chunk_id"))
    return by_chunk.withColumn("rank", rank).where(F.col("rank") <= k)


def fact_text(source: Column, target: Column, description: Column) -> Column:
    return F.concat(source, F.lit(" → "), target, F.lit(": "), description)


def candidate_facts(matched: DataFrame, relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(qid, pos, text): the matched relations (qid, rank, relation_id), then, in the order of the ids, those that touch a seed (qid, key)."""
    text = fact_text(F.col("source"), F.col("target"), F.col("description")).alias("text")
    rows = relations.select("relation_id", "source", "target", text)
    first = matched.hint("merge").join(rows, "relation_id").select("qid", F.struct(F.lit(0).alias("k"), F.col("rank").cast("long").alias("n")).alias("pos"), "text")
    ends = rows.select("relation_id", "text", F.explode(F.array("source", "target")).alias("key"))
    touching = seeds.select("qid", "key").hint("merge").join(ends, "key").select("qid", F.struct(F.lit(1).alias("k"), F.col("relation_id").cast("long").alias("n")).alias("pos"), "text")
    return first.unionByName(touching)


def facts(matched: DataFrame, most: int = MAX_FACTS, characters: int = MAX_FACTS_CHARS) -> DataFrame:
    """Facts (qid, pos, text) in order, each once, up to the first that would be one too many or pass the number of characters."""
    first = matched.groupBy("qid", "text").agg(F.min("pos").alias("pos"))
    w = Window.partitionBy("qid").orderBy("pos", "text")
    run = first.withColumn("n", F.row_number().over(w)).withColumn("chars", F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.where((F.col("n") <= most) & (F.col("chars") <= characters)).select("qid", "n", "text")


def entities_shown(nodes: DataFrame, seeds: DataFrame, entities: DataFrame) -> DataFrame:
    """(qid, place, name, score, hop): the linked entities (hop 0), then the best of those reached (hop 1), by score and name."""
    linked = seeds.select("qid", "key", F.lit(0).alias("hop")).distinct()
    found = nodes.hint("merge").join(entities.select("key", "name"), "key").join(linked.hint("merge"), ["qid", "key"], "left").withColumn("hop", F.coalesce("hop", F.lit(1)))
    order = (F.desc(F.round("score", 9)), F.col("name"))
    found = found.withColumn("n", F.row_number().over(Window.partitionBy("qid", "hop").orderBy(*order))).where(f"hop = 0 or n <= {MAX_NEIGHBOURS}")
    return found.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("hop", *order)).alias("place"), "name", "score", "hop")


def graph_retrieve(questions: DataFrame, entities: DataFrame, relations: DataFrame, links: DataFrame, chunks: DataFrame, k_entities: int = 5, k_relations: int = 5, k: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Retrieval through the graph, for all questions (qid, vector) at once: (contexts, facts, entities shown).

    The nearest entities (key, name, vector, chunk_ids) by vector are the seeds, weighted by their specificity, and
    pass their score on (:func:`expand`); chunks sum the scores of their nodes and of the nearest relations
    (relation_id, source, target, description, vector, chunk_ids), which weigh the geometric mean of their ends'
    specificity. ``links`` are synonyms (key, other, weight), both ways; ``chunks`` (chunk_id) are those there are.
    """
    weighted = specificity(entities, chunks.count())
    spec = weighted.select("key", "specificity")
    seeds = top_k(questions, entities.select(F.col("key").alias("chunk_id"), "vector"), k_entities).select("qid", F.col("chunk_id").alias("key"), "score")
    seeds = written(seeds.hint("merge").join(spec, "key").select("qid", "key", (F.col("score") * F.col("specificity")).alias("score")), "seeds")
    matched = top_k(questions, relations.select(F.col("relation_id").alias("chunk_id"), "vector"), k_relations).withColumnRenamed("chunk_id", "relation_id")
    matched = written(matched, "matched")
    ends = matched.hint("merge").join(relations.select("relation_id", "source", "target", "chunk_ids"), "relation_id")
    for side in ("source", "target"):
        ends = ends.hint("merge").join(spec.select(F.col("key").alias(side), F.col("specificity").alias(f"{side}_weight")), side, "left")
    weight = F.sqrt(F.coalesce("source_weight", F.lit(0.0)) * F.coalesce("target_weight", F.lit(0.0)))
    nodes = expand(seeds, relations, links, spec)
    nodes = written(nodes, "nodes")
    mentions = entities.select("key", F.explode("chunk_ids").alias("chunk_id"))
    contexts = score_chunks(nodes, mentions, k, ends.select("qid", "chunk_ids", (F.col("score") * weight).alias("score")), chunks)
    return contexts.select("qid", "rank", "chunk_id", "score"), facts(candidate_facts(matched, relations, seeds)), entities_shown(nodes, seeds, entities)


#: Fixed value: the line between passages and facts in a prompt.
FACTS_HEADER = "Fatos do Grafo de conhecimento:"


def graph_context(context: DataFrame, found: DataFrame) -> DataFrame:
    """(qid, context): the passages (qid, context) with the facts (qid, n, text) below them, if there are any."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: F.concat(F.lit("- "), x["text"])), "\n")
    listed = found.groupBy("qid").agg(lines.alias("facts"))
    joined = context.join(listed.hint("merge"), "qid", "full")
    with_facts = F.concat(F.coalesce("context", F.lit("")), F.lit(f"\n\n{FACTS_HEADER}\n"), F.col("facts"))
    return joined.select("qid", F.when(F.col("facts").isNull(), F.col("context")).otherwise(with_facts).alias("context"))


def _gate_key(name: Column) -> Column:
    return one_space(fold(F.regexp_replace(name, r"\s*\([^)]*\)", "")))


def gate(found: DataFrame, found_relations: DataFrame, key: DataFrame, key_relations: DataFrame, least: float = 90, pass_recall: float = 0.6) -> DataFrame:
    """Precision and recall of extracted entities and relations against an answer key, by section and in all (section null).

    ``found`` (section, name), ``found_relations`` (section, source, target), ``key`` (section, entity, names: the name
    and its aliases), ``key_relations`` (section, a, b: entities). A name stands for the key's entity with the
    greatest Indel ratio, if it is ``least`` or more; pairs of a relation have no direction. A section's key is a
    short list made by hand, so a section's distinct names meet all of it. A gate is passed with entity recall of
    ``pass_recall``.
    """
    spelt = key.select("section", "entity", F.explode("names").alias("n")).select("section", "entity", _gate_key(F.col("n")).alias("known"))
    ends = [found_relations.select("section", F.col(c).alias("name")) for c in ("source", "target")]
    names = found.select("section", "name").unionByName(ends[0]).unionByName(ends[1]).distinct().withColumn("said", _gate_key(F.col("name")))
    pairs = names.hint("merge").join(spelt.hint("merge"), "section").withColumn("ratio", indel_ratio(F.col("said"), F.col("known"))).where(F.col("ratio") >= least)
    match = pairs.groupBy("section", "name").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "entity"))["entity"].alias("entity"))
    e = found.select("section", "name").hint("merge").join(match, ["section", "name"], "left").groupBy("section").agg(F.count("*").alias("entities_predicted"), F.count("entity").alias("entities_correct"), F.countDistinct("entity").alias("entities_found"))
    side = lambda c: match.select("section", F.col("name").alias(c), F.col("entity").alias(f"{c}_entity"))
    r = found_relations.hint("merge").join(side("source"), ["section", "source"], "left").hint("merge").join(side("target"), ["section", "target"], "left")
    pair = lambda a, b: F.struct(F.least(a, b).alias("x"), F.greatest(a, b).alias("y"))
    whole = F.col("source_entity").isNotNull() & F.col("target_entity").isNotNull()
    r = r.select("section", F.when(whole, pair("source_entity", "target_entity")).alias("pair"))
    gold = key_relations.select("section", pair("a", "b").alias("pair")).distinct().withColumn("known", F.lit(True))
    hit = r.hint("merge").join(gold, ["section", "pair"], "left")
    r = hit.groupBy("section").agg(F.count("*").alias("relations_predicted"), F.count("known").alias("relations_correct"), F.countDistinct(F.when(F.col("known"), F.col("pair"))).alias("relations_found"))
    counts = key.groupBy("section").agg(F.countDistinct("entity").alias("entities_gold"))
    counts = counts.join(gold.groupBy("section").agg(F.count("*").alias("relations_gold")).hint("merge"), "section", "left").join(e.hint("merge"), "section", "left").join(r.hint("merge"), "section", "left").fillna(0)
    sums = [c for c in counts.columns if c != "section"]
    out = counts.groupingSets([["section"], []], "section").agg(*(F.sum(c).alias(c) for c in sums))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    recall = share("entities_found", "entities_gold")
    return out.select(
        "section", *sums, recall.alias("entity_recall"), share("entities_correct", "entities_predicted").alias("entity_precision"),
        share("relations_found", "relations_gold").alias("relation_recall"), share("relations_correct", "relations_predicted").alias("relation_precision"), (recall >= pass_recall).alias("passed"),
    )


def lenient(name: Column) -> Column:
    """Letters and digits alone, without accents and case, single spaces between words."""
    return F.btrim(F.regexp_replace(fold(name), r"[^0-9a-z]+", " "))


def bridges_found(bridges: Column, names: Column) -> Column:
    """(entity, found) for each annotated bridge entity: whether a name that the graph found equals it, spelling aside.

    Empty without a graph (null names); bridges without a letter or digit are left out.
    """
    plain = F.transform(names, lenient)
    some = F.filter(F.coalesce(bridges, F.array().cast("array<string>")), lambda b: lenient(b) != "")
    found = F.transform(some, lambda b: F.struct(b.alias("entity"), F.array_contains(plain, lenient(b)).alias("found")))
    return F.when(names.isNotNull(), found).otherwise(F.array().cast("array<struct<entity:string,found:boolean>>"))


def common_extractors(graphs: DataFrame, indexes: int) -> DataFrame:
    """Extractors whose graph all the chosen indexes have."""
    return graphs.groupBy("extractor").agg(F.countDistinct("index").alias("n")).where(F.col("n") == indexes).select("extractor")


def chosen_extractor(indexes: DataFrame, graphs: DataFrame, wanted: str | None = None) -> DataFrame:
    """One row (extractor, error): the extractor that an experiment's graph techniques query, or why there is none.

    Without a wanted one it is the only extractor with a current graph of every chosen index (``indexes``: index;
    ``graphs``: index, extractor). The chosen indexes are a configuration's, a short list.
    """
    chosen = indexes.select("index").distinct()
    have = chosen.join(graphs.select("index", "extractor").distinct().hint("merge"), "index", "left")
    by_extractor = have.where("extractor is not null").groupBy("extractor").agg(F.countDistinct("index").alias("n"))
    total = chosen.agg(F.count("*").alias("total"))  # one row
    common = by_extractor.crossJoin(total).agg(F.array_sort(F.collect_list(F.when(F.col("n") == F.col("total"), F.col("extractor")))).alias("common"))
    ok = F.lit(False) if wanted is None else F.bool_or(F.coalesce(F.col("extractor") == wanted, F.lit(False)))
    by_index = have.groupBy("index").agg(F.count("extractor").alias("graphs"), ok.alias("ok") if wanted is not None else F.first(F.lit(False)).alias("ok"))
    state = by_index.agg(F.bool_and(F.col("graphs") > 0).alias("all"), F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("index").cast("string")))).alias("missing"))
    row = state.crossJoin(common)  # one row each
    missing = F.concat(F.lit("no current graph of "), F.array_join("missing", ", "))
    if wanted is not None:
        return row.select(F.when(F.size("missing") == 0, wanted).alias("extractor"), F.when(F.size("missing") > 0, missing).alias("error"))
    n = F.size("common")
    several = F.concat(F.lit("several extractors fit: "), F.array_join("common", ", "))
    return row.select(F.when(n == 1, F.col("common")[0]).alias("extractor"), F.when(n > 1, several).when((n == 0) & F.col("all"), "the indexes have graphs of different extractors").when(n == 0, missing).alias("error"))


def current_graphs(graphs: DataFrame, fingerprints: DataFrame, prompt_version: str, graph_version: str) -> DataFrame:
    """Graphs (index, extractor, fingerprint, prompt_version, graph_version) that still fit their index's chunks and both versions."""
    live = graphs.where((F.col("prompt_version") == prompt_version) & (F.col("graph_version") == graph_version))
    return live.join(fingerprints.select("index", "fingerprint"), ["index", "fingerprint"], "left_semi").select("index", "extractor")


def to_build(wanted: DataFrame, current: DataFrame) -> DataFrame:
    """(index, extractor) pairs without a current graph."""
    return wanted.join(current.hint("merge"), ["index", "extractor"], "left_anti")
