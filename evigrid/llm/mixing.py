"""Documents mixed to target weights of a tree of domains, languages and sources.

1. A document's tokens are its words; a leaf (domain, lang, source) has the sum of its documents and can give at most EPOCHS times
   that. Sums are partial aggregates.
2. The budget goes down the tree. A node's children share its budget by their weights, no child above what its subtree can give;
   what a child can't take goes to its siblings by their weights, and so on. As a node asks for no more than its subtree can
   give, a shortage reaches a node's siblings only after all below the node are full. The children are ordered by capacity
   over weight: with B and W what is left of budget and weights before a child, it is full if capacity * W <= weight * B, and the others get
   floor(weight * B / W). These are running sums over siblings, in whole numbers.
3. A leaf gives the prefix of its token stream: epoch 1, 2, ... each with all its documents in the order of md5(seed:epoch:doc_id), up to the
   budget; the document in which the budget ends gives its first tokens. Whole epochs need no order, so only the last epoch of a
   leaf is summed up, in two levels by slices of the hash, so that a leaf with a third of all documents is many tasks.

Defined cases: a null text has no tokens, and documents without tokens are never taken. Null lang, source or domain is a value of its
own, named ''. Rows that repeat a doc_id are documents of their own, ordered by the md5 of their text. Leaves without a target weight, or
of weight 0, get nothing; targets without documents give their share to siblings. Extra columns are kept. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evigrid.operators.ordering import running_sum

from .shared import settled

LEVELS = ("domain", "lang", "source")
EPOCHS, SEED = 2, 17
WORD = r"[^\x20\x09-\x0D]+"
WHOLE = "decimal(38,0)"


def _shared_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Budgets of the children of every parent: columns weight, cap, parent_budget -> budget."""
    heavy = nodes.where("weight > 0")
    ratio = F.col("cap").cast("double") / F.col("weight")
    before = Window.partitionBy(*parent).orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*parent)
    left = heavy.withColumn("b", (F.col("parent_budget") - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast(WHOLE)).withColumn(
        "w", (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast(WHOLE))
    # once a child isn't full, none after it is: b and w of the first such child hold for all of them
    full = (F.col("cap") * F.col("w")).cast(WHOLE) <= (F.col("weight") * F.col("b")).cast(WHOLE)
    left = left.withColumn("full", full)
    upto = Window.partitionBy(*parent).orderBy(ratio, name).rowsBetween(Window.unboundedPreceding, 0)
    first = F.first(F.when(~F.col("full"), F.struct("b", "w")), ignorenulls=True).over(upto)
    left = left.withColumn("open", first)
    share = F.expr("(weight * open.b) div open.w").cast("long")
    return left.withColumn("budget", F.when(F.col("open").isNull(), F.col("cap")).otherwise(share)).drop("b", "w", "full", "open")


def leaf_budgets(leaves: DataFrame, targets: DataFrame, total: Column, epochs: int = EPOCHS) -> DataFrame:
    """leaves: LEVELS, tokens; targets: LEVELS, weight (whole numbers; a node weighs what its leaves weigh).
    LEVELS, tokens, cap, budget of the leaves with tokens and weight."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in LEVELS]
    wanted = targets.select(*named, F.col("weight").cast("long").alias("weight")).groupBy(*LEVELS).agg(F.sum("weight").alias("weight"))
    joined = settled(leaves.join(wanted, list(LEVELS)).where("weight > 0 AND tokens > 0").withColumn("cap", F.col("tokens") * F.lit(epochs)))
    domains = joined.groupBy("domain").agg(F.sum("weight").alias("weight"), F.sum("cap").alias("cap"))
    whole = domains.agg(F.least(total, F.sum("cap")).cast("long").alias("parent_budget"))
    domains = domains.crossJoin(F.broadcast(whole)).withColumn("root", F.lit(0))  # one row: the budget
    domains = _shared_out(domains, ["root"], "domain").select("domain", F.col("budget").alias("parent_budget"))
    langs = joined.groupBy("domain", "lang").agg(F.sum("weight").alias("weight"), F.sum("cap").alias("cap")).join(domains, "domain")
    langs = _shared_out(langs, ["domain"], "lang").select("domain", "lang", F.col("budget").alias("parent_budget"))
    out = _shared_out(joined.join(langs, ["domain", "lang"]), ["domain", "lang"], "source")
    return out.select(*LEVELS, "tokens", "cap", "budget")


def mix(docs: DataFrame, targets: DataFrame, domain: Column, share: tuple[int, int], seed: int = SEED, epochs: int = EPOCHS) -> DataFrame:
    """All columns of docs and mix_domain, mix_epoch (from 1), mix_tokens (tokens of the text), mix_start (tokens of the leaf's stream
    before it), mix_take (its tokens that count); columns of docs with these names are replaced. The total budget is share[0] / share[1]
    of all tokens."""
    given = [c for c in docs.columns if c not in ("mix_domain", "mix_epoch", "mix_tokens", "mix_start", "mix_take")]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    leaf = ["mix_domain", "mix_lang", "mix_source"]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"mix_c{i}") for i, c in enumerate(given)],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("mix_tokens"), F.coalesce(domain.cast("string"), F.lit("")).alias("mix_domain"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"mix_{c}") for c in ("lang", "source")],
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("mix_id"), F.md5(text.cast("binary")).alias("mix_tie")).where("mix_tokens > 0")
    sums = settled(rows.groupBy(*[F.col(c).alias(n) for c, n in zip(leaf, LEVELS, strict=True)]).agg(F.sum("mix_tokens").alias("tokens")))
    total = sums.agg(F.expr(f"(sum(tokens) * {share[0]}) div {share[1]}")).first()[0] or 0  # one number
    budgets = leaf_budgets(sums, targets, F.lit(total).cast("long"), epochs).select(
        *[F.col(n).alias(c) for c, n in zip(leaf, LEVELS, strict=True)], F.col("tokens").alias("mix_leaf"), F.col("budget").alias("mix_budget"))
    # what of the budget falls to an epoch: all tokens, or in the last one the rest
    past = (F.col("mix_epoch") - 1) * F.col("mix_leaf")
    parts = budgets.withColumn("mix_epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn(
        "mix_part", F.least("mix_leaf", F.col("mix_budget") - past)).where("mix_part > 0")
    spot = F.md5(F.concat(F.lit(f"{seed}:"), F.col("mix_epoch").cast("string"), F.lit(":"), F.col("mix_id")).cast("binary"))
    dealt = rows.join(settled(parts), leaf).withColumn("mix_order", spot)
    placed = running_sum(dealt, [*leaf, "mix_epoch"], [F.col("mix_order"), F.col("mix_tie")], F.substring("mix_order", 1, 2),
                         F.col("mix_tokens"), "mix_end")
    start = F.col("mix_end") - F.col("mix_tokens")
    return placed.where(start < F.col("mix_part")).select(
        *[F.col(f"mix_c{i}").alias(c) for i, c in enumerate(given)], "mix_domain", F.col("mix_epoch").cast("int").alias("mix_epoch"), "mix_tokens",
        (past + start).alias("mix_start"), F.least(F.col("mix_tokens"), F.col("mix_part") - start).alias("mix_take"))


def domain_of(source: Column) -> Column:
    """Domains of the given tables: the source's number by four; a source without number is of domain 0."""
    return F.concat(F.lit("d"), F.pmod(_number(source), F.lit(4)).cast("string"))


def _number(source: Column) -> Column:
    return F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))


def targets_of(docs: DataFrame) -> DataFrame:
    """Target weights of the given tables: English 5, other languages 2, by 1, 2 or 3 after the source's number."""
    leaves = docs.select(domain_of(F.col("source")).alias("domain"), "lang", "source").distinct()
    return leaves.withColumn("weight", F.when(F.col("lang") == "en", 5).otherwise(2) * (1 + F.pmod(_number(F.col("source")), F.lit(3))))


SHARE = (1, 2)


def mixed_documents(docs: DataFrame, share: tuple[int, int] = SHARE) -> DataFrame:
    return mix(docs, targets_of(docs), domain_of(F.col("source")), share)


def _level_sql(name: str, parent: str, key: str, nodes: str) -> str:
    part = f"PARTITION BY {parent}" if parent else ""
    order = f"ORDER BY CAST(cap AS DOUBLE) / weight, {key}"
    return f"""
{name}_left AS (
  SELECT *, parent_budget - coalesce(sum(cap) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b,
    sum(weight) OVER ({part}) - coalesce(sum(weight) OVER ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w
  FROM ({nodes})),
{name}_open AS (
  SELECT *, first_value(CASE WHEN cap * w > weight * b THEN b END IGNORE NULLS) OVER s AS ob,
    first_value(CASE WHEN cap * w > weight * b THEN w END IGNORE NULLS) OVER s AS ow
  FROM {name}_left WINDOW s AS ({part} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
{name} AS (SELECT * EXCLUDE (b, w, ob, ow, parent_budget), CAST(CASE WHEN ob IS NULL THEN cap ELSE weight * ob // ow END AS HUGEINT) AS budget FROM {name}_open)"""


SQL = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, md5(coalesce(text, '')) AS tie,
    coalesce(TRY_CAST(regexp_extract(source, '([0-9]{1,9})$', 1) AS INT), 0) AS num,
    len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+')) AS tokens FROM documents),
named AS (SELECT *, 'd' || (num % 4) AS domain FROM docs),
leaves AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(2 * sum(tokens) AS HUGEINT) AS cap,
    CAST(max((CASE WHEN lang = 'en' THEN 5 ELSE 2 END) * (1 + num % 3)) AS HUGEINT) AS weight
  FROM named WHERE tokens > 0 GROUP BY ALL),""" + _level_sql(
    "dom", "", "domain", """SELECT domain, sum(weight) AS weight, sum(cap) AS cap,
    least((SELECT sum(tokens) // 2 FROM leaves), (SELECT sum(cap) FROM leaves)) AS parent_budget FROM leaves GROUP BY domain""") + "," + _level_sql(
    "lng", "domain", "lang", """SELECT domain, lang, sum(l.weight) AS weight, sum(l.cap) AS cap, any_value(d.budget) AS parent_budget
    FROM leaves l JOIN dom d USING (domain) GROUP BY domain, lang""") + "," + _level_sql(
    "src", "domain, lang", "source", """SELECT l.*, g.budget AS parent_budget FROM leaves l JOIN lng g USING (domain, lang)""") + r""",
dealt AS (
  SELECT n.*, e.e, least(s.tokens, s.budget - (e.e - 1) * s.tokens) AS part, (e.e - 1) * s.tokens AS past
  FROM named n JOIN src s USING (domain, lang, source) CROSS JOIN (VALUES (1), (2)) e(e)
  WHERE n.tokens > 0 AND least(s.tokens, s.budget - (e.e - 1) * s.tokens) > 0),
placed AS (
  SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, e ORDER BY md5('17:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), '')), tie
    ROWS UNBOUNDED PRECEDING) - tokens AS start FROM dealt)
SELECT doc_id, lang, source, domain AS mix_domain, CAST(e AS INT) AS mix_epoch, CAST(tokens AS BIGINT) AS mix_tokens,
  CAST(past + start AS BIGINT) AS mix_start, CAST(least(tokens, part - start) AS BIGINT) AS mix_take
FROM placed WHERE start < part
"""
