"""Fact sets to reports and back, as whole-table jobs.

Rendering and parsing work row by row on built-in expressions and need no shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortine.functions import phrases as P
from cohortine.functions import reports as R
from cohortine.functions import vocab as V
from cohortine.functions.scalars import lookup, size3

FACTS = ["laterality", "total_n", "total_qualifier", "n_characterized", "right", "left", "largest", "anomalies"]


def fact_columns() -> dict[str, Column]:
    names = {c: F.col(c) for c in FACTS}
    return {**names, "qualifier": F.col("total_qualifier")}


def build_factset(records: DataFrame, stones: DataFrame, order: Sequence[str]) -> DataFrame:
    """Canonical fact set per case.

    ``records``: case_id, laterality, n_effective, qualifier, anomalies (array).
    ``stones``: case_id, side, zone, mm, cls and the ``order`` columns. A record holds all
    its findings, so a case is one row by its nature; nothing else is gathered.
    """
    item = F.struct("zone", "mm", "cls")
    side = lambda s: F.collect_list(F.when(F.col("side") == s, item))
    lead = F.when(F.col("mm").isNotNull(), F.struct(-F.col("mm"), *order))
    grouped = stones.groupBy("case_id").agg(
        side("RIGHT").alias("__r"), side("LEFT").alias("__l"), F.count(F.lit(1)).alias("n_characterized"),
        F.min_by(F.struct("side", "zone", "mm", "cls"), lead).alias("largest"),
    )
    j = records.join(grouped, "case_id", "left")
    within = lambda s: F.col("laterality").isin("BILATERAL", s)
    return j.select(
        "case_id",
        "laterality",
        F.when(F.col("qualifier") != "MANY", F.col("n_effective")).cast("int").alias("total_n"),
        F.col("qualifier").alias("total_qualifier"),
        F.coalesce("n_characterized", F.lit(0)).cast("int").alias("n_characterized"),
        R.kidney_facts(F.col("__r"), within("RIGHT")).alias("right"),
        R.kidney_facts(F.col("__l"), within("LEFT")).alias("left"),
        "largest",
        F.sort_array("anomalies").alias("anomalies"),
    )


def with_hash(facts: DataFrame) -> DataFrame:
    """Adds the content hash."""
    f = fact_columns()
    keys = ("laterality", "total_n", "qualifier", "n_characterized", "right", "left", "anomalies")
    return facts.withColumn("facts_hash", R.facts_hash(*[f[k] for k in keys]))


def render_reports(facts: DataFrame, lang: str, seed: int) -> DataFrame:
    """Adds findings, impression and the full report text.

    Clauses, sentences and paragraphs are columns one after the other, so that each is made once however often it is used.
    """
    f, v = fact_columns(), F.col("__v")
    out = facts.withColumn("__v", R.choose_variants(F.col("case_id"), seed))
    first = R.side_first(f, v)
    sides = ("right", "left")
    out = out.withColumns({f"__c_{s}": R.side_clauses(F.col(s), s, v, lang) for s in sides})
    out = out.withColumns({f"__b_{s}": R.side_body(F.col(f"__c_{s}"), s, v, lang) for s in sides})
    out = out.withColumns({f"__s_{s}": R.side_sentence(F.col(f"__b_{s}"), s, first[s], v, lang) for s in sides})
    findings = R.findings_text(f, v, {s: F.col(f"__s_{s}") for s in sides}, lang)
    out = out.withColumns({"findings": findings, "impression": R.impression_text(f, v, lang)})
    out = out.drop("__v", *(f"__{k}_{s}" for k in "cbs" for s in sides))
    return out.withColumn("report", R.full_report(F.col("findings"), F.col("impression"), lang))


def read_sentences(texts: DataFrame, lang: str) -> DataFrame:
    """Adds ``__c``, the described findings (side, zone, mm, cls) of the findings paragraph ``__f``, to each row; ``__s``, the
    side of each sentence; and ``__t``, the total of the last sentence that states one. A row holds what one text says.

    The clauses are found once in the whole paragraph, as none reaches beyond a sentence, and leave their fields behind marks.
    """
    s = texts.withColumn("__g", F.lower(R.marked_clauses(F.col("__f"), lang)))
    s = s.withColumn("__p", R.sentence_parts(F.col("__g")))
    totals = F.filter(F.transform("__p", lambda x: R.stated_total(x, "findings", lang)), lambda n: n.isNotNull())
    s = s.withColumn("__t", F.when(F.col("__g").contains(P.before_slot(P.TOTAL["findings"][lang])), totals))
    s = s.withColumn("__s", F.transform("__p", lambda x: R.sentence_side(x, lang)))
    # behind every second mark stands a clause
    codes = lambda x: F.transform(F.filter(F.split(x, R.CODE), lambda c, i: i % 2 == 1), lambda c: F.split(c, R.NEXT))
    fields = lambda c: [v.alias(k) for k, v in R.clause_fields(c, lang).items()]
    found = F.zip_with("__p", "__s", lambda x, side: F.when(side.isNotNull(), F.transform(codes(x), lambda c: F.struct(side.alias("side"), *fields(c)))))
    s = s.withColumn("__c", F.flatten(F.filter(found, lambda c: c.isNotNull())))
    return s.withColumn("__t", F.get("__t", F.size("__t") - 1)).drop("__g", "__p")


def parse_reports(texts: DataFrame, lang: str, text: str = "report", carry: Sequence[str] = ()) -> DataFrame:
    """Fact set of every report text, row by row, without a shuffle; case_id and the ``carry`` columns are kept.

    Every step is a column after the other, so that none is made twice. A total or "many" of the impression counts only
    where the findings state no total.
    """
    s = texts.select("case_id", *carry, R.findings_section(F.col(text)).alias("__f"), F.lower(R.impression_section(F.col(text))).alias("__i"))
    s = read_sentences(s, lang).withColumn("__f", F.lower("__f"))
    side = lambda name: F.transform(
        F.filter("__c", lambda c: (c["side"] == name) & c["zone"].isNotNull()), lambda c: F.struct(c["zone"], c["mm"], c["cls"])
    )
    named = lambda name: F.coalesce(F.array_contains("__s", name), F.lit(False))
    says = lambda phrase: F.coalesce(F.col("__f").contains(phrase), F.lit(False))
    stated = F.coalesce(R.stated_total(F.col("__i"), "impression", lang), F.when(F.col("__i").contains(P.SINGLE[lang]), 1))
    s = s.select(
        "case_id", *carry, R.kidney_facts(side("RIGHT"), named("RIGHT")).alias("right"), R.kidney_facts(side("LEFT"), named("LEFT")).alias("left"),
        F.coalesce("__t", stated).alias("__t"),
        (says(P.MANY["findings"][lang]) | (F.col("__t").isNull() & F.col("__i").contains(P.MANY["impression"][lang]))).alias("__m"),
        F.sort_array(F.array_compact(F.array(*(F.when(says(cue), name) for name, cue in P.CUES[lang].items())))).alias("anomalies"),
    )
    n = F.col("right.n_characterized") + F.col("left.n_characterized")
    r, l = F.col("right.present"), F.col("left.present")
    return s.select(
        "case_id", *carry,
        F.when(r & l, "BILATERAL").when(r, "RIGHT").when(l, "LEFT").otherwise("NONE").alias("laterality"),
        F.when(~F.col("__m"), F.coalesce("__t", F.nullif(n, F.lit(0)))).alias("total_n"),
        F.when(F.col("__m"), "MANY").otherwise("EXACT").alias("total_qualifier"),
        n.alias("n_characterized"),
        "right",
        "left",
        R.largest_of(F.col("right"), F.col("left")).alias("largest"),
        "anomalies",
    )


TOP_FACTS = [c for c in FACTS if c not in ("right", "left")]
SIDE_FACTS = ["present", "n_characterized", "max_mm", "max_cls", "zones", "stones"]


def differing_fields(
    a: str, b: str, top_facts: Sequence[str] = TOP_FACTS, side_facts: Sequence[str] = SIDE_FACTS
) -> Column:
    """Names of the facts that differ between two fact-set structs."""
    top = [F.when(~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")), c) for c in top_facts]
    deep = [
        F.when(~F.col(f"{a}.{k}.{c}").eqNullSafe(F.col(f"{b}.{k}.{c}")), f"kidneys.{k}.{c}")
        for k in ("right", "left")
        for c in side_facts
    ]
    return F.array_compact(F.array(*top, *deep))


def diff_facts(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differing facts per case of two fact-set tables."""
    a = left.select("case_id", F.struct(*FACTS).alias("a"))
    b = right.select("case_id", F.struct(*FACTS).alias("b"))
    return a.join(b, "case_id").select("case_id", differing_fields("a", "b").alias("differences"))


def round_trip(
    facts: DataFrame,
    lang: str,
    seed: int,
    top_facts: Sequence[str] = TOP_FACTS,
    side_facts: Sequence[str] = SIDE_FACTS,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Facts -> text -> facts, with the differences and the length of the text per case; the ``carry`` columns are kept."""
    rendered = render_reports(facts, lang, seed).select(
        "case_id", *carry, "report", F.struct(*FACTS).alias("a"), F.length("report").alias("n_chars")
    )
    back = parse_reports(rendered, lang, carry=[*carry, "a", "n_chars"])
    return back.withColumn("b", F.struct(*FACTS)).select(
        "case_id", *carry, differing_fields("a", "b", top_facts, side_facts).alias("differences"), "n_chars"
    )


def round_trips(facts: DataFrame, langs: Sequence[str], seed: int) -> DataFrame:
    """(case_id, lang, differences) of the round trip in each language; the facts are made once for all of them."""
    out, done = facts.select("case_id", F.struct(*FACTS).alias("a")), []
    for lang in langs:
        rendered = render_reports(out.select("case_id", "a.*", "a", *done), lang, seed).select("case_id", "a", *done, "report")
        back = parse_reports(rendered, lang, carry=["a", *done]).withColumn("b", F.struct(*FACTS))
        out = back.select("case_id", "a", *done, differing_fields("a", "b").alias(f"__{lang}"))
        done.append(f"__{lang}")
    trips = [F.struct(F.lit(lang).alias("lang"), F.col(c).alias("differences")) for lang, c in zip(langs, done, strict=True)]
    return out.select("case_id", F.inline(F.array(*trips)))


PAIR = ["__rp", "__lp", "__r", "__l"]


def side_pairs(sides: DataFrame) -> DataFrame:
    """(seed, case_id) with the predicted sides as the ``PAIR`` columns: presence and guess, right and left."""
    pick = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    return sides.groupBy("seed", "case_id").agg(
        pick("RIGHT", "present").alias("__rp"), pick("LEFT", "present").alias("__lp"),
        pick("RIGHT", "guess").alias("__r"), pick("LEFT", "guess").alias("__l"),
    )


def equal_reports(pairs: DataFrame, seed: int) -> DataFrame:
    """The pairs whose reports are the same in every language, as they have equal sides and equal wording: one of their
    case_ids and their number n, for each seed. They are bounded by the vocabulary, however many the cases are."""
    wording = R.choose_variants(F.col("case_id"), seed)
    return pairs.groupBy("seed", *PAIR, wording.alias("__v")).agg(F.min("case_id").alias("case_id"), F.count(F.lit(1)).alias("n")).drop("__v")


def predicted_facts(sides: DataFrame) -> DataFrame:
    """Fact set of each (seed, case) from its predicted sides: no size in mm, no count."""
    return pair_facts(side_pairs(sides))


def pair_facts(pairs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """Fact set of each row of pairs; the ``carry`` columns are kept."""

    def stones(guess: str) -> Column:
        g = F.col(guess)
        one = F.struct(g["zone"].alias("zone"), F.lit(None).cast("double").alias("mm"), lookup(g["cls"], V.SIZE3_TO_CLASS).alias("cls"))
        return F.when(g.isNotNull(), F.array(one))

    no = F.lit(False)
    g = pairs.withColumn("right", R.kidney_facts(stones("__r"), F.coalesce("__rp", no))).withColumn(
        "left", R.kidney_facts(stones("__l"), F.coalesce("__lp", no))
    )
    r, l = F.col("right.present"), F.col("left.present")
    return g.select(
        "seed",
        "case_id",
        *carry,
        F.when(r & l, "BILATERAL").when(r, "RIGHT").when(l, "LEFT").otherwise("NONE").alias("laterality"),
        F.lit(None).cast("int").alias("total_n"),
        F.lit("EXACT").alias("total_qualifier"),
        (F.col("right.n_characterized") + F.col("left.n_characterized")).alias("n_characterized"),
        "right",
        "left",
        F.lit(None).cast("struct<side:string,zone:string,mm:double,cls:string>").alias("largest"),
        F.array().cast("array<string>").alias("anomalies"),
    )


def reduced_facts(kidneys: DataFrame, stones: DataFrame) -> DataFrame:
    """Reference facts per side on the three-class scale."""
    refs = stones.groupBy("case_id", "side").agg(
        F.count(F.lit(1)).alias("n"), F.array_join(F.sort_array(F.collect_set("zone")), ",").alias("zones"),
        F.max("mm").alias("max_mm"),
    )
    return kidneys.select("case_id", "side", "has_stone", "max_class").join(refs, ["case_id", "side"], "left").select(
        "case_id", "side", F.col("has_stone").alias("present"), F.coalesce("n", F.lit(0)).alias("n_characterized"),
        F.coalesce("zones", F.lit("")).alias("zones"), "max_mm", size3(F.col("max_class")).alias("max_cls"),
    )


def stone_tuples(facts: DataFrame) -> DataFrame:
    """(case, side, zone, class) rows of a fact-set table."""
    def rows(key: str) -> Column:
        side = F.lit(key.upper()).alias("side")
        return F.transform(F.col(f"{key}.stones"), lambda s: F.struct(side, s["zone"].alias("zone"), s["cls"].alias("cls")))

    both = F.concat(rows("right"), rows("left"))
    return facts.select("case_id", F.inline(both))


def case_comparison(kidneys: DataFrame, preds: DataFrame) -> DataFrame:
    """Facts and mean predictions side by side, with the disagreement and its reason."""
    means = preds.groupBy("case_id", "side").agg(F.avg("p").alias("p_stone"), F.avg("z_hat").alias("z_hat"))
    j = kidneys.join(means, ["case_id", "side"], "left")
    differs = F.coalesce((F.col("p_stone") > 0.5) != F.col("has_stone"), F.lit(False))
    why = F.when(
        differs,
        F.when(F.col("has_stone") & (F.col("n_characterized") == 0), "label without a characterized stone").otherwise(
            "disagreement despite the label, worth review"
        ),
    )
    return j.select(
        "case_id", "side", "has_stone", "n_characterized", "max_mm", "max_class", "p_stone", "z_hat",
        differs.alias("disagreement"), why.alias("reason"),
    )
