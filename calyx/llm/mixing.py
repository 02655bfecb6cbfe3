"""Mixing sources to target weights by hierarchical budgeting (operator 5).

A budget of tokens runs down a domain-language-source tree. At each node it is shared
among the children in proportion to their weights; a child that has fewer tokens (times
``epochs``, how often a text may be used) takes all it has, and its shortage goes to its
siblings by their weights. A node never gets more than its leaves hold, so what one family
lacks is made up inside it before other branches of the ancestors get more.

A leaf spends its budget in epochs: whole epochs first, then a prefix of one more, in the
order of md5(seed:epoch:doc_id): the texts whose running sum stays within the rest.
The prefix is found from sums over 4,096 slices of the order, so no leaf's texts are
ordered in one task; only the slice in which the budget ends is ordered.

Tokens are words between ASCII white space. Texts without a word (null, empty) aren't mixed.
Null lang or source is a leaf of its own, named ''. Rows of one doc_id share their place in the
order and enter together. An empty table gives an empty result. Other columns stay as
they are in ``mix``. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calyx.llm.common import WORD, stage

#: Part of all tokens that the mixture should have, how often a text may be used at most, and the seed.
SHARE, EPOCHS, SEED = 0.5, 2, "calyx"
#: Weights by name; a name without one has 1.
DOMAINS = {"prose": 4.0, "table": 1.0}
LANGS = {"en": 2.0}
LEVELS = ("domain", "lang", "source")
#: Hexadecimal digits of the order that name a slice.
SLICE = 3


def domain_of(text: Column) -> Column:
    """The form of a text: a table of cells between bars, or prose."""
    return F.when(F.contains(text, F.lit(" | ")), "table").otherwise("prose")


def weight_of(name: Column, weights: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for k, w in sorted(weights.items()):
        out = F.when(name == k, F.lit(float(w))).otherwise(out)
    return out


def share_out(children: DataFrame, budget: DataFrame | None, above: tuple[str, ...], name: str) -> DataFrame:
    """Budgets of ``children(*above, name, tokens, weight)`` from those of their parents (*above, budget).

    With children in order of tokens by weight, the level (budget - tokens of the children before) / (weight of
    this one and those after) rises while children are short and falls after; its maximum is the level that
    all others get, times their weight.
    """
    c = children.join(budget, list(above)) if above else children
    by = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
    run = by.orderBy(F.col("tokens") / F.col("weight"), name)
    before = F.coalesce(F.sum("tokens").over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    back = by.orderBy((F.col("tokens") / F.col("weight")).desc(), F.desc(name)).rowsBetween(Window.unboundedPreceding, 0)
    c = c.withColumn("level", (F.col("budget") - before) / F.sum("weight").over(back))
    return c.select(*above, name, F.least(F.col("tokens").cast("double"), F.max("level").over(by) * F.col("weight")).alias("budget"))


def budgets(leaves: DataFrame, share: float = SHARE, epochs: int = EPOCHS, domains: dict | None = None, langs: dict | None = None,
            sources: dict | None = None) -> DataFrame:
    """(domain, lang, source, tokens, budget) of ``leaves(domain, lang, source, tokens)``; budget in whole tokens."""
    weights = dict(zip(LEVELS, (DOMAINS if domains is None else domains, LANGS if langs is None else langs, sources or {})))
    room = leaves.withColumn("tokens", F.col("tokens") * epochs)
    got = None
    for k, name in enumerate(LEVELS):
        children = room.groupBy(*LEVELS[:k + 1]).agg(F.sum("tokens").alias("tokens")).withColumn("weight", weight_of(F.col(name), weights[name]))
        if not k:  # a row for each domain: the root's budget stands beside it
            children = children.withColumn("budget", F.sum("tokens").over(Window.partitionBy(F.lit(0))) / epochs * share)
        got = share_out(children.where("weight > 0"), got, LEVELS[:k], name)
    return leaves.join(got, list(LEVELS)).select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def order_of(seed: str, epoch: Column, doc_id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(seed), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def cuts(digest: DataFrame, budget: DataFrame, epochs: int, seed: str) -> DataFrame:
    """(domain, lang, source, epoch, cut): a text is in an epoch of its leaf when its place in the order is at most ``cut``."""
    rest = (budget.select(*LEVELS, "tokens", "budget", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
            .withColumn("quota", F.least(F.col("tokens"), F.col("budget") - F.col("epoch") * F.col("tokens"))).where("quota > 0"))
    whole = rest.where("quota = tokens").select(*LEVELS, "epoch", F.lit("g").alias("cut"))  # above every hexadecimal digit
    part = rest.where("quota < tokens").select(*LEVELS, "epoch", "quota")
    key = [*LEVELS, "epoch", "slice"]
    placed = (digest.join(part, list(LEVELS)).withColumn("place", order_of(seed, F.col("epoch"), F.col("doc_id")))
              .withColumn("slice", F.substring("place", 1, SLICE)))
    slices = placed.groupBy(*key, "quota").agg(F.sum("n_tokens").alias("n"))
    upto = Window.partitionBy(*LEVELS, "epoch").orderBy("slice")
    slices = slices.withColumn("upto", F.sum("n").over(upto))
    last = slices.where("upto > quota and upto - n < quota").select(*key, (F.col("upto") - F.col("n")).alias("before"))
    full = slices.where("upto <= quota").groupBy(*LEVELS, "epoch").agg(F.concat(F.max("slice"), F.lit("g")).alias("cut"))
    inside = placed.join(last, key).withColumn("upto", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*key).orderBy("place")))
    inside = inside.where("upto <= quota").groupBy(*LEVELS, "epoch").agg(F.max("place").alias("cut"))
    return whole.union(full.union(inside).groupBy(*LEVELS, "epoch").agg(F.max("cut").alias("cut")))


def leaf_columns() -> dict[str, Column]:
    return {"domain": domain_of(F.coalesce("text", F.lit(""))), "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}


def mix(docs: DataFrame, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, **weights) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, source, ...)`` that the mixture takes, once for each epoch, with the new
    columns domain, epoch and n_tokens in place of any of these names."""
    leaf = leaf_columns()
    words = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    digest = stage(docs.select("doc_id", *(c.alias(k) for k, c in leaf.items()), words.alias("n_tokens")).where("n_tokens > 0"), "mix-digest")
    leaves = stage(digest.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    budget = stage(budgets(leaves, share, epochs, **weights), "mix-budgets")
    cut = stage(cuts(digest, budget, epochs, seed), "mix-cuts")
    own = [c for c in docs.columns if c not in ("domain", "epoch", "n_tokens")]
    rows = docs.select(*own, *(c.alias(f"_{k}") for k, c in leaf.items()), words.alias("n_tokens")).where("n_tokens > 0")
    took = rows.join(cut.toDF("_domain", "_lang", "_source", "epoch", "_cut"), ["_domain", "_lang", "_source"])
    took = took.where(order_of(seed, F.col("epoch"), F.col("doc_id")) <= F.col("_cut"))
    return took.select(*own, F.col("_domain").alias("domain"), "epoch", "n_tokens")


def mixture(docs: DataFrame) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens) of the mixture."""
    return mix(docs.select("doc_id", "text", "lang", "source")).select("doc_id", "domain", "lang", "source", "epoch", "n_tokens")


def _level_sql(name: str, above: tuple[str, ...], parents: str) -> str:
    keys = ", ".join((*above, name))
    part = f"partition by {', '.join(above)}" if above else ""
    join = f"join {parents} p using ({', '.join(above)})" if above else f"cross join {parents} p"
    weights = {"domain": DOMAINS, "lang": LANGS, "source": {}}[name]
    weight = "case " + " ".join(f"when {name} = '{k}' then {w}" for k, w in weights.items()) + " else 1.0 end" if weights else "1.0"
    return f"""child_{name} as (select {keys}, cast(sum(tokens) * {EPOCHS} as double) as tokens, cast({weight} as double) as weight from leaves group by {keys}),
level_{name} as (select c.*, p.budget as parent,
    (p.budget - (sum(c.tokens) over ({part} order by c.tokens / c.weight, {name} rows unbounded preceding) - c.tokens))
    / sum(c.weight) over ({part} order by c.tokens / c.weight, {name} rows between current row and unbounded following) as lev
    from child_{name} c {join}),
got_{name} as (select {keys}, least(tokens, max(lev) over ({part}) * weight) as budget from level_{name})"""


#: The mixture in DuckDB: the same budgets, but each prefix by one running sum over the leaf.
ORACLE = rf"""with digest as (select doc_id, case when text like '% | %' then 'table' else 'prose' end as domain,
    coalesce(lang, '') as lang, coalesce(source, '') as source,
    cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint) as n_tokens, lang as own_lang, source as own_source
    from documents),
leaves as (select domain, lang, source, sum(n_tokens) as tokens from digest where n_tokens > 0 group by all),
got as (select cast(sum(tokens) * {SHARE} as double) as budget from leaves),
{_level_sql('domain', (), 'got')},
{_level_sql('lang', ('domain',), 'got_domain')},
{_level_sql('source', ('domain', 'lang'), 'got_lang')},
quota as (select domain, lang, source, e.epoch, least(l.tokens, cast(floor(g.budget + 1e-6) as bigint) - e.epoch * l.tokens) as quota
    from leaves l join got_source g using (domain, lang, source) cross join (select unnest(range({EPOCHS})) as epoch) e),
run as (select d.*, q.epoch, q.quota, sum(d.n_tokens) over (partition by domain, lang, source, q.epoch
    order by md5('{SEED}:' || cast(q.epoch as varchar) || ':' || coalesce(cast(doc_id as varchar), ''))) as upto
    from digest d join quota q using (domain, lang, source) where d.n_tokens > 0 and q.quota > 0)
select doc_id, domain, own_lang as lang, own_source as source, cast(epoch as integer) as epoch, n_tokens from run where upto <= quota"""
