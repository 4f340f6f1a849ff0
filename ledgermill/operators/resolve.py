"""From a question's words to a metric of the dictionary, and from a report's names to the dictionary's.

Dictionaries have name, metric_id, kind, parent_id; ``entries`` adds the synonyms.  Questions meet names on words (every
prefix of a question's word is a key), never in a cross product.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermill.operators.retrieval import STOPWORDS, tokens

ACCEPT, MARGIN = 0.35, 0.05
MERGE, MERGE_MARGIN = 0.55, 0.08


def entries(metrics: DataFrame, synonyms: DataFrame) -> DataFrame:
    """Names and then synonyms, in the order in which ties are settled; requisites are no answers."""
    m = metrics.where(F.coalesce("kind", F.lit("other")) != "identifier")
    own = m.select("name", "metric_id", F.lit(0).alias("from_synonym"))
    return own.unionByName(synonyms.join(m.select("metric_id"), "metric_id", "left_semi").select(F.col("text").alias("name"), "metric_id", F.lit(1).alias("from_synonym")))


def exact(questions: DataFrame, dictionary: DataFrame) -> DataFrame:
    """query_id and metric_id where the metric words are a name, or else a synonym.

    A name is looked up in its first entry only, so that a name of many entries doesn't meet its questions once for each.
    """
    q = questions.select("query_id", F.lower(F.trim("metric_query")).alias("name"))
    first = dictionary.groupBy(F.lower("name").alias("name")).agg(F.min(F.struct("from_synonym", "metric_id")).alias("first"))
    return q.join(first, "name").groupBy("query_id").agg(F.min("first").alias("first")).select("query_id", "first.metric_id")


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"\s+", "")


def lexical(questions: DataFrame, dictionary: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """The name with most words that a question covers all of.

    A name's word is covered by an equal word of the question, one of under five letters also as its beginning; a name
    of four letters or more is covered too if it stands in the question without regard to blanks.

    Questions of the same words are one form, looked up once, and so are names of the same words; a name meets only the
    forms that have the word (or the gram of four letters) of it that is in the fewest of them.
    """
    split_digits = F.regexp_replace("metric_query", r"(?iu)(?<=\d)(?=[а-яёa-z])", " ")
    asked = questions.select("query_id", F.array_distinct(tokens(split_digits, stopwords)).alias("t"), _squeezed(F.col("metric_query")).alias("all"))
    asked = asked.groupBy("query_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("t")))).alias("words"), F.sort_array(F.collect_set("all")).alias("texts"))
    forms = asked.groupBy("words", "texts").agg(F.min("query_id").alias("form"))
    named = dictionary.groupBy("name").agg(F.min(F.struct("from_synonym", "metric_id")).alias("_first")).withColumn("words", F.sort_array(F.array_distinct(tokens(F.col("name"), stopwords)))).where(F.size("words") > 0)
    named = named.select("words", F.struct((-F.size("words")).alias("n"), "_first.from_synonym", "name", "_first.metric_id").alias("best"), _squeezed(F.col("name")).alias("glued"))
    # Only short words of a name may be met by a prefix; a longer one has five letters and is its own key.
    prefixes = F.flatten(F.transform("words", lambda t: F.array_union(F.array(t), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.left(t, i)))))
    met = _covered(forms.select("form", F.array_distinct(prefixes).alias("has")), named.groupBy(F.col("words").alias("needs")).agg(F.min("best").alias("best")))
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1))), lambda i: F.substring(c, i, F.lit(4)))
    glued = named.where(F.length("glued") >= 4).groupBy("glued").agg(F.min("best").alias("best")).select("best", "glued", F.array_distinct(grams(F.col("glued"))).alias("needs"))
    whole = forms.select("form", F.array_distinct(F.flatten(F.transform("texts", grams))).alias("has"), "texts")
    inside = _covered(whole, glued).where(F.exists("texts", lambda t: F.contains(t, F.col("glued"))))
    found = met.select("form", "best").unionByName(inside.select("form", "best")).groupBy("form").agg(F.min("best").alias("best"))
    answers = forms.join(found, "form").select(F.col("words").alias("_words"), F.col("texts").alias("_texts"), "best")
    return asked.join(answers, (F.col("words") == F.col("_words")) & (F.col("texts") == F.col("_texts"))).select("query_id", "best.metric_id", "best.name")


def _covered(forms: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs of forms (form, has) and names (best, needs), both with what else they hold, where the form has all that the name needs."""
    held = forms.select("*", F.explode("has").alias("_key"))
    often = held.groupBy("_key").agg(F.count(F.lit(1)).alias("_often"))
    met = names.select("best", F.size("needs").alias("_n"), F.explode("needs").alias("_key")).join(often, "_key")
    rarest = met.groupBy("best", "_n").agg(F.min(F.struct("_often", "_key")).alias("_rarest"), F.count(F.lit(1)).alias("_met")).where("_met = _n")
    by_key = names.join(rarest.select("best", F.col("_rarest._key").alias("_key")), "best")
    return held.join(by_key, "_key").where(F.size(F.array_except("needs", "has")) == 0)


def semantic(candidates: DataFrame, stopwords: tuple[str, ...] = STOPWORDS) -> DataFrame:
    """Decide among scored candidates (query_id, metric_query, metric_id, name, is_aggregate, score).

    Candidates must share the beginning of a word with the question; «X итого» goes if X is there; total words prefer
    aggregates.  The best is taken if it is clearly best and near enough; otherwise up to three names are offered.
    """
    stems = lambda c: F.array_distinct(F.transform(tokens(c, stopwords), lambda t: F.left(t, F.lit(4))))
    w = Window.partitionBy("query_id")
    best = candidates.groupBy("query_id", "metric_query", "metric_id", "name", "is_aggregate").agg(F.max("score").alias("score"))
    near = best.where(F.arrays_overlap(stems(F.col("metric_query")), stems(F.col("name"))))
    names = F.collect_set("name").over(w)
    near = near.withColumn("_names", names).where(~(F.endswith("name", F.lit(" итого")) & F.array_contains("_names", F.regexp_replace("name", " итого$", ""))))
    total = F.lower("metric_query").rlike(r"(?<![а-яё])(всего|итого|общ)")
    near = near.withColumn("_agg", F.max(F.col("is_aggregate").cast("int")).over(w)).where(~total | (F.col("_agg") == 0) | F.col("is_aggregate"))
    order = w.orderBy(F.col("score").desc(), "name")
    near = near.withColumn("_r", F.row_number().over(order)).withColumn("_next", F.lead("score").over(order))
    top = near.where("_r = 1").select("query_id", F.when(((F.col("score") - F.col("_next") > MARGIN) | F.col("_next").isNull()) & (F.col("score") >= ACCEPT), F.col("metric_id")).alias("metric_id"), "score")
    offer = near.where(F.col("_r") <= 3).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "name"))), lambda x: x["name"]).alias("offer"))
    return top.join(offer, "query_id").select("query_id", "metric_id", F.when(F.col("metric_id").isNull() & (F.col("score") >= ACCEPT), F.col("offer")).alias("clarify"))


def resolve(*steps: DataFrame) -> DataFrame:
    """First answer per question of several steps (query_id, metric_id), in the order in which they are given."""
    ranked = [s.select("query_id", "metric_id", F.lit(i).alias("step")) for i, s in enumerate(steps)]
    all_ = ranked[0]
    for r in ranked[1:]:
        all_ = all_.unionByName(r)
    return all_.where("metric_id is not null").groupBy("query_id").agg(F.min_by("metric_id", "step").alias("metric_id"), F.min("step").alias("step"))


def link_hierarchy(scanned: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(metric_id, parent_id): the section of a metric's first fact if it is a metric, else its parent hint; never itself.

    ``scanned``: metric, section, parent_hint, cell_ref (the first by it counts); ``dictionary``: metric_id, name.
    """
    first = scanned.groupBy("metric").agg(F.min_by(F.struct("section", "parent_hint"), "cell_ref").alias("said")).select(F.col("metric").alias("name"), F.lower("said.section").alias("section"), F.lower("said.parent_hint").alias("parent_hint"))
    named = lambda name, id_: dictionary.select(F.lower("name").alias(name), F.col("metric_id").alias(id_))
    met = first.join(dictionary.select("name", "metric_id"), "name").join(named("section", "_section"), "section", "left").join(named("parent_hint", "_hint"), "parent_hint", "left")
    return met.select("metric_id", F.coalesce("_section", "_hint").alias("parent_id")).where("parent_id is not null and parent_id <> metric_id")


def backfill_kinds(metrics: DataFrame) -> DataFrame:
    """Kinds of metrics that have none, from their names."""
    from ledgermill.functions.names import kind_of

    return metrics.withColumn("kind", F.when(F.coalesce("kind", F.lit("other")) == "other", kind_of(F.col("name"))).otherwise(F.col("kind")))


def unique_codes(metrics: DataFrame) -> DataFrame:
    """Codes of metrics (metric_id, name): a slug, numbered from the second that has it."""
    from ledgermill.functions.names import slug

    w = Window.partitionBy("_slug").orderBy("metric_id")
    rows = metrics.withColumn("_slug", slug(F.col("name"))).withColumn("_n", F.row_number().over(w))
    return rows.withColumn("code", F.when(F.col("_n") == 1, F.col("_slug")).otherwise(F.concat_ws("_", "_slug", F.col("_n").cast("string")))).drop("_slug", "_n")


def default_parent(metrics: DataFrame) -> DataFrame:
    """The metric that a question without one means: the only parent, else the first with money."""
    parents = metrics.join(metrics.where("parent_id is not null").select(F.col("parent_id").alias("metric_id")).distinct(), "metric_id", "left_semi")
    return parents.orderBy(F.col("currency").isNull(), "metric_id").limit(1)


@dataclass
class Known:
    name: str
    vector: np.ndarray
    kind: str = "other"
    parent: str | None = None
    code: str = ""


def merge_names(names: Sequence[tuple[str, str, np.ndarray]], known: list[Known], protected: frozenset[str] = frozenset(), stems=lambda s: {w[:4] for w in s.split()}) -> tuple[dict[str, str], list[tuple[str, str]], set[str]]:
    """Names of one report against the dictionary, in order, as each may add to it: (name, kind, unit vector) triples.

    Returns name → dictionary name, (new name, old name) renamings, and the names to be reviewed.  A name that contains
    a known one becomes its child; a near one of a like kind with a shared word is the same metric under a newer name, if
    nothing else is nearly as near; anything else is new.  Names of the same report are never merged with one another.
    """
    result, renamed, review = {}, [], set()
    here = {n for n, _, _ in names}
    for name, kind, vector in sorted(names, key=lambda x: x[0]):
        if any(k.name == name for k in known):
            result[name] = name
            continue
        parent = next((k.name for k in known if len(name) > len(k.name) and k.name in name), None)
        if parent is None:
            open_ = [k for k in known if (kind == "other" or k.kind in ("other", kind)) and k.name not in here and k.name not in protected and stems(name) & stems(k.name)]
            scored = sorted(((float(vector @ k.vector), i) for i, k in enumerate(open_)), key=lambda x: (-x[0], x[1]))
            if scored and scored[0][0] >= MERGE:
                if len(scored) == 1 or scored[0][0] - scored[1][0] > MERGE_MARGIN:
                    old = open_[scored[0][1]]
                    renamed.append((name, old.name))
                    old.name, old.vector = name, vector
                    result[name] = name
                    continue
                review.add(name)
        known.append(Known(name, vector, kind, parent))
        result[name] = name
    return result, renamed, review
