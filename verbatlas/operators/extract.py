"""Verb-argument constructions in dependency-parsed utterances, by higher-order functions.

One shuffle brings an utterance's tokens together, without Python workers. For the tree they are
an ordered array, and all that follows is expressions over it, one row per verb; the linear
extractor keeps a row per token and uses windows, so that no row grows with the utterance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import lexicon as lx
from ..functions import columns as c
from ..schemas import META, with_defaults

OPTIONAL = {
    "stem": "string", "suffix": "string", "gra_index": "long", "gra_head": "long", "gra_relation": "string",
    "token_order": "long", "id": "long", "gloss": "string", "utterance_type": "string", "type": "string",
}


def tagged_tokens(tokens: DataFrame) -> DataFrame:
    """Tokens of known utterances: place, tags and links in one spelling, and what tells of their utterance."""
    meta = [m for m in META if m in tokens.columns]
    x = with_defaults(tokens, **OPTIONAL)
    source = F.col("parse_source") if "parse_source" in tokens.columns else F.lit("childesdb")
    kind = F.lower(F.trim(F.col("utterance_type"))).isin(*lx.QUESTION_TYPES) | F.coalesce(F.lower(F.trim(F.col("type"))).isin(*lx.QUESTION_TYPES), F.lit(False))
    return x.where(F.col("utterance_id").isNotNull()).select(
        "utterance_id", F.col("token_order").cast("long").alias("at"), F.col("id").cast("long").alias("id"), c.norm_pos("part_of_speech").alias("pos"), c.norm_rel("gra_relation").alias("rel"),
        c.lemma("stem", "gloss").alias("lemma"), F.coalesce(F.col("gra_index").try_cast("long"), F.col("id").cast("long")).alias("node"), F.col("gra_head").try_cast("long").alias("head"),
        F.coalesce(F.col("suffix").contains("Ger"), F.lit(False)).alias("gerund"), (F.coalesce(F.trim("gloss"), F.lit("")) == "?").alias("mark"),
        F.coalesce(kind, F.lower(F.trim(F.col("type"))).isin(*lx.QUESTION_TYPES), F.lit(False)).alias("asks"), source.alias("parse_source"), *meta)


def utterances(tokens: DataFrame, require_verb: bool = True) -> DataFrame:
    """One row per utterance: ``ts``, its tokens in order, ``is_question``, ``parse_source`` and the meta columns of its first token.

    Utterances without an id, without any relation or, if required, without a token tagged as a
    verb are left out, as flags of the same aggregation.
    """
    meta = [m for m in META if m in tokens.columns]
    token, first = F.struct("at", "id", "pos", "rel", "lemma", "node", "head", "gerund"), F.struct("asks", "parse_source", *meta)
    g = tagged_tokens(tokens).select("utterance_id", token.alias("t"), first.alias("first"), "mark")
    g = g.groupBy("utterance_id").agg(
        F.array_sort(F.collect_list("t")).alias("ts"), F.min_by("first", F.struct("t.at", "t.id")).alias("first"), F.bool_or("mark").alias("mark"),
        F.bool_or(F.col("t.rel") != "").alias("parsed"), F.bool_or(F.col("t.pos").isin(*lx.VERB_POS)).alias("has_verb"))
    g = g.where("parsed and has_verb" if require_verb else "parsed")
    return g.select("utterance_id", "ts", (F.col("mark") | F.col("first.asks")).alias("is_question"), F.col("first.parse_source").alias("parse_source"), *[F.col(f"first.{m}").alias(m) for m in meta])


def children(ts: Column, node: Column) -> Column:
    return F.filter(ts, lambda t: t["head"] == node)


def first_of(a: Column) -> Column:
    return F.get(a, F.lit(0))


def oblique_preposition(ts: Column, obl: Column) -> Column:
    """Its own lemma if it is an adposition, else that of its first adposition, else of its first case marker."""
    kids = children(ts, obl["node"])
    adp = first_of(F.filter(kids, lambda k: k["pos"].isin(*lx.ADP_POS)))
    case = first_of(F.filter(kids, lambda k: k["rel"].isin(*lx.CASE_RELS)))
    return F.when(obl["pos"].isin(*lx.ADP_POS), obl["lemma"]).otherwise(F.coalesce(adp["lemma"], case["lemma"]))


def with_rels(kids: Column, rels: tuple[str, ...]) -> Column:
    return F.filter(kids, lambda k: k["rel"].isin(*rels))


def hit(holds: Column, construction: str, prep: Column | None = None, extra: bool = False) -> Column:
    return F.when(holds, F.struct(F.lit(construction).alias("construction"), (F.lit(None).cast("string") if prep is None else prep).alias("preposition"), F.lit(extra).alias("extra")))


def emitted(rows: DataFrame, hits: list[Column], extractor: str, verb: Column, meta: list[str]) -> DataFrame:
    x = rows.select("utterance_id", verb.alias("verb"), "parse_source", *meta, F.explode(F.array_compact(F.array(*hits))).alias("h"))
    return x.select("utterance_id", "verb", "h.construction", "h.preposition", "parse_source", F.lit(extractor).alias("extractor"), "h.extra", *meta)


def extract_ud(utts: DataFrame, stratum: str | None = None, extras: bool = True) -> DataFrame:
    """Constructions from the tree: a verb, its objects and its locative preposition."""
    meta = [m for m in META if m in utts.columns]
    vl, vol = c.prepositions("VL", stratum), c.prepositions("VOL", stratum)
    both = tuple(dict.fromkeys(vl + vol))
    asked = utts.where(~F.col("is_question"))
    ts = F.col("ts")
    verbs = F.concat(F.filter(ts, lambda t: t["pos"].isin(*lx.VERB_POS)), F.filter(ts, lambda t: ~t["pos"].isin(*lx.VERB_POS) & t["gerund"]))
    x = asked.withColumn("vs", verbs).withColumn("v", F.explode(F.filter("vs", lambda v, k: ~F.exists(F.slice("vs", F.lit(1), k), lambda u: u["id"] == v["id"]))))
    x = x.withColumn("kids", children(ts, F.col("v.node")))
    kids = F.col("kids")
    x = x.where(~F.exists(kids, lambda k: k["rel"].isin(*lx.PASSIVE_RELS)))
    obls = F.transform(with_rels(kids, lx.OBL_RELS), lambda o: oblique_preposition(ts, o))
    particles = F.transform(with_rels(kids, lx.PRT_RELS), lambda k: k["lemma"])
    known = lambda a: first_of(F.filter(a, lambda p: p.isin(*both)))
    n_obj = F.size(with_rels(kids, lx.OBJ_RELS))
    x = x.withColumns({
        "has_obj": n_obj >= 1,
        "has_iobj": F.exists(kids, lambda k: k["rel"].isin(*lx.IOBJ_RELS)) | (n_obj >= 2),
        "prep": F.coalesce(known(obls), known(particles)),
        "gives": F.col("v.lemma").isin(*lx.DITRANSITIVE),
    })
    obj, iobj, prep = F.col("has_obj"), F.col("has_iobj"), F.col("prep")
    in_vol = F.coalesce(prep.isin(*vol), F.lit(False))
    hits = [
        hit(prep.isin(*vl) & ~obj, "VL", prep), hit(in_vol & obj, "VOL", prep),
        hit(obj & iobj & F.col("gives"), "VOO"), hit(obj & ~iobj & ~in_vol, "VO"),
    ]
    if extras:
        hits += [
            hit(obj & F.exists(kids, lambda k: k["rel"] == "xcomp"), "resultative", extra=True), hit(~obj & ~iobj & prep.isNull(), "intransitive", extra=True),
            hit(obj & (prep == "to") & F.col("gives"), "prep_dative", prep, extra=True),
        ]
    out = emitted(x, hits, "ud", F.col("v.lemma"), meta)
    if extras:
        cops = asked.withColumn("v", F.explode(F.filter(ts, lambda t: t["rel"] == "cop")))
        out = out.union(emitted(cops, [hit(F.lit(True), "copular", extra=True)], "ud", F.col("v.lemma"), meta))
    return out


def extract_linear(tokens: DataFrame, stratum: str | None = None, require_verb: bool = True) -> DataFrame:
    """Constructions from neighbouring words: a preposition next to the verb or after up to three noun-phrase words.

    Two noun phrases in a row are one run of such words, so this extractor finds no VOO. Tokens stay
    rows: one window, from an utterance's end, tells each the word that ends the noun phrases after
    it (``stop``); another brings verbs and their dependents together.
    """
    meta = ["parse_source", *[m for m in META if m in tokens.columns]]
    vl, vol = c.prepositions("VL", stratum), c.prepositions("VOL", stratum)
    pos, rel, known = F.col("pos"), F.col("rel"), F.col("pos").isin(*lx.ADP_POS) & F.col("lemma").isin(*vl, *vol)
    role = F.when(rel.isin(*lx.PASSIVE_RELS), "passive").when(rel.isin(*lx.OBJ_RELS), "obj").when(rel.isin(*lx.IOBJ_RELS), "iobj")
    verbal, is_np = pos.isin(*lx.VERB_POS) | F.col("gerund"), pos.isin(*lx.NP_POS)
    x = tagged_tokens(tokens).select(
        "utterance_id", "at", "id", "node", "head", verbal.alias("verbal"), is_np.alias("np"), role.alias("role"), F.when(verbal | known, F.col("lemma")).alias("lemma"), known.alias("known"),
        (rel != "").alias("parsed"), pos.isin(*lx.VERB_POS).alias("verb"), "mark", "asks", *meta)
    back = Window.partitionBy("utterance_id").orderBy(F.desc("at"), F.desc("id"), F.desc("node"))
    after, whole = back.rowsBetween(Window.unboundedPreceding, -1), back.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    x = x.withColumns({"p": F.row_number().over(back), "ok": F.bool_or("parsed").over(whole), "verbs": F.bool_or("verb").over(whole), "asked": F.bool_or("mark").over(whole) | F.last("asks").over(whole)} | {m: F.last(m).over(whole) for m in meta})
    x = x.withColumns({"stop": F.last(F.when(~F.col("np"), F.col("p")), True).over(after), "prep": F.last(F.when(~F.col("np"), F.when(F.col("known"), F.col("lemma")).otherwise("")), True).over(after)})
    x = x.where("ok and not asked and (verbal or role is not null)" + " and verbs" * require_verb)
    ends = F.array(F.struct(F.col("node").alias("key"), F.lit(False).alias("kid")), F.struct(F.col("head").alias("key"), F.lit(True).alias("kid")))
    x = x.select("utterance_id", "p", "verbal", "lemma", "stop", "prep", "role", *meta, F.inline(ends)).where("if(kid, role is not null and key is not null, verbal)")
    own = Window.partitionBy("utterance_id", "key").orderBy("p", "kid")
    after, whole = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    is_kid = lambda role: F.col("kid") & F.coalesce(F.col("role") == role, F.lit(False))
    x = x.withColumns({r: F.bool_or(is_kid(r)).over(whole) for r in ("passive", "obj", "iobj")} | {"next": F.last(F.when(is_kid("obj"), F.col("p")), True).over(after)})
    gap, prep = F.col("p") - F.col("stop") - 1, F.col("prep")
    hits = [
        hit((gap == 0) & prep.isin(*vl) & ~F.col("obj"), "VL", prep), hit(gap.between(1, 3) & prep.isin(*vol) & (F.col("next") > F.col("stop")), "VOL", prep),
        hit((F.col("next") > F.coalesce("stop", F.lit(0))) & ~F.col("iobj"), "VO"),
    ]
    return emitted(x.where("not kid and not passive"), hits, "s74", F.col("lemma"), meta[1:])


def extract(tokens: DataFrame, extractor: str = "ud", stratum: str | None = None, extras: bool = True, require_verb: bool = True) -> DataFrame:
    """Hits of all utterances; ``extractor`` is ``ud`` (the tree) or ``s74`` (linear windows)."""
    if extractor == "ud":
        return extract_ud(utterances(tokens, require_verb), stratum, extras)
    if extractor == "s74":
        return extract_linear(tokens, stratum, require_verb)
    raise ValueError(extractor)


def explode_strata(hits: DataFrame) -> DataFrame:
    """A row for each stratum of a hit, so that young parents also count among all; late prepositions leave the young strata."""
    x = with_defaults(hits, stratum="string", target_child_age="double", speaker_role="string", preposition="string")
    found = F.coalesce(c.strata("speaker_role", "target_child_age"), F.array().cast("array<string>"))
    x = x.withColumn("stratum", F.explode_outer(F.when(F.size(found) > 0, found).when(F.coalesce(F.col("stratum"), F.lit("")) != "", F.array("stratum"))))
    return x.where(c.counted_in("stratum", "preposition"))
