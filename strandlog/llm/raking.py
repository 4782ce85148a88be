"""Mixing sources to target weights by iterative proportional fitting, with DataFrame functions only.

Documents fall into cells of (source, language, topic). The cells' token sums are scaled in turn so that their sums
over each dimension meet that dimension's targets, again and again (raking). A cell's factor, divided by the largest
one, is the chance with which each of its documents is drawn; the drawn tokens then have the target shares in
expectation. Draws depend on the seed and the document's id only.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlog.llm.common import durable, free_name, shared_folder

DIMS = ("source", "lang", "topic")
#: At most so many rounds; they end when no marginal is off its target by more than this share of all tokens.
ROUNDS, TOLERANCE = 20, 1e-13
#: Without given targets, the target of a value is its token share to this power, normalised.
TEMPERATURE = 0.8
#: So many cells fit in one partition, where windows sum them without an exchange. More are summed by groups and joined. Sums
#: are exact, so both ways give the same.
PARTITION_CELLS = 100_000
SEED = "mix"
NONE = "(none)"


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def topic(text: Column) -> Column:
    """A coarse topic by form: legal, markup, numeric or prose."""
    t = F.coalesce(text, F.lit(""))
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    return (
        F.when(F.lower(t).contains("license"), "legal")
        .when(without("#*$%&|<>") * 20 > F.length(t), "markup")
        .when(without("0123456789") * 50 > F.length(t), "numeric")
        .otherwise("prose")
    )


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id: the first twelve hexadecimal digits of an md5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary")), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def default_targets(cells: DataFrame, dim: str, temperature: float) -> DataFrame:
    """dim, share: token shares to the power of temperature, normalised."""
    sums = cells.groupBy(dim).agg(F.sum("tokens").alias("n")).select(dim, F.pow(F.col("n").cast("double"), F.lit(temperature)).alias("raw"))
    total = sums.agg(F.sum("raw").alias("total"))
    return sums.join(F.broadcast(total)).select(dim, (F.col("raw") / F.col("total")).alias("share"))  # one row


def rake(cells: DataFrame, dims: tuple[str, ...] = DIMS, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE) -> DataFrame:
    """dims, tokens, fitted, residual of every cell. cells: dims and tokens, one row a cell.

    targets: for a dimension, a DataFrame (dimension, share); a value without a share there gets none of the tokens.
    Sums of zero stay zero. residual is the same for all cells: the largest distance of a marginal from its target after the
    last round, as a share of all tokens; it stays large where targets contradict each other or need tokens that no cell has.

    Sums are exact (decimals), so no dealing of the cells changes them.
    """
    numbers = cells.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("cells")).first()
    total = float(numbers["tokens"] or 0)
    given = targets or {}
    aims = {d: durable((given[d].select(d, "share") if d in given else default_targets(cells, d, temperature)).select(d, (F.col("share") * total).alias("aim"))) for d in dims}
    fitted = cells.select(*dims, "tokens", F.col("tokens").cast("double").alias("fitted"))
    step, residual, at = (by_windows if numbers["cells"] <= PARTITION_CELLS else by_groups), 0.0, 0
    while at < rounds:
        n = min(5, rounds - at)
        fitted, at = step(fitted, dims, aims, n), at + n
        off = None
        for d in dims:
            sums = fitted.groupBy(d).agg(exact_sum("fitted").alias("have")).join(aims[d], d, "left")
            one = sums.agg(F.max(F.abs(F.col("have") - F.coalesce("aim", F.lit(0.0)))).alias("off"))
            off = one if off is None else off.unionAll(one)
        residual = (off.agg(F.max("off")).first()[0] or 0.0) / total if total else 0.0
        if residual <= TOLERANCE:
            break
    return fitted.withColumn("residual", F.lit(residual))


def exact_sum(column: str) -> Column:
    """A sum that does not depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(28,9)")).cast("double")


def by_windows(fitted: DataFrame, dims: tuple[str, ...], aims: dict[str, DataFrame], rounds: int) -> DataFrame:
    """Rounds over few cells: all in one partition, without an exchange."""
    columns = fitted.columns
    for d in dims:
        fitted = fitted.join(aims[d].withColumnRenamed("aim", f"aim_{d}"), d, "left")
    fitted = fitted.coalesce(1)
    for _ in range(rounds):
        for d in dims:
            have = F.sum(F.col("fitted").cast("decimal(28,9)")).over(Window.partitionBy(d)).cast("double")
            fitted = fitted.withColumn("fitted", F.col("fitted") * F.coalesce(F.col(f"aim_{d}") / F.when(have > 0, have), F.lit(0.0)))
    return durable(fitted.select(*columns))


def by_groups(fitted: DataFrame, dims: tuple[str, ...], aims: dict[str, DataFrame], rounds: int) -> DataFrame:
    """Rounds over any number of cells: partial sums before each shuffle, so a value that most cells share costs no more than
    others. Each round is written as a table: a checkpoint would carry on the size that Spark estimates, which joins multiply."""
    spark, columns = fitted.sparkSession, fitted.columns
    for _ in range(rounds):
        for d in dims:
            sums = fitted.groupBy(d).agg(exact_sum("fitted").alias("have")).join(aims[d], d, "left")
            scale = sums.select(d, F.coalesce(F.col("aim") / F.when(F.col("have") > 0, F.col("have")), F.lit(0.0)).alias("scale"))
            fitted = fitted.join(scale, d).select(*[c for c in columns if c != "fitted"], (F.col("fitted") * F.col("scale")).alias("fitted"))
        place = f"{shared_folder(spark).rstrip('/')}/rake-{uuid.uuid4().hex}"
        fitted.select(*columns).write.parquet(place)
        fitted = spark.read.parquet(place)
    return fitted


def cell_of(docs: DataFrame, features: dict[str, Column] | None) -> dict[str, Column]:
    own = {"source": docs["source"], "lang": docs["lang"], "topic": topic(docs["text"])} | (features or {})
    return {d: F.coalesce(own[d].cast("string"), F.lit(NONE)) for d in DIMS}


def cell_chances(rows: DataFrame, targets: dict[str, DataFrame] | None, rounds: int, temperature: float) -> DataFrame:
    """DIMS, weight, prob, residual of every cell of rows (DIMS, tokens)."""
    cells = durable(rows.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens")))
    fitted = rake(cells, DIMS, targets, rounds, temperature)
    weights = fitted.select(*DIMS, "residual", F.coalesce(F.col("fitted") / F.when(F.col("tokens") > 0, F.col("tokens")), F.lit(0.0)).alias("weight"))
    top = weights.agg(F.max("weight").alias("top"))
    prob = F.coalesce(F.col("weight") / F.when(F.col("top") > 0, F.col("top")), F.lit(0.0))
    return durable(weights.join(F.broadcast(top)).select(*DIMS, "weight", "residual", prob.alias("prob")))  # top is one row


def mix(docs: DataFrame, features: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """doc_id, source, lang, topic, tokens, weight, prob, residual, sampled of every row of docs (doc_id, text, source, lang).

    weight is the cell's fitted tokens over its own, prob the chance of being drawn (0 where a cell has no tokens), residual
    how far the marginals are from their targets (see rake). Null values of a dimension are one value, "(none)"; null and
    empty texts have no tokens. Repeated rows count each; they share their draw. Other columns are not read.
    """
    own = cell_of(docs, features)
    rows = durable(docs.select(docs["doc_id"].alias("doc_id"), *[c.alias(d) for d, c in own.items()], n_tokens(docs["text"]).alias("tokens")))
    return rows.join(cell_chances(rows, targets, rounds, temperature), list(DIMS)).select(
        "doc_id", *DIMS, "tokens", F.round("weight", 6).alias("weight"), F.round("prob", 9).alias("prob"), F.round("residual", 6).alias("residual"), (draw(F.col("doc_id"), seed) < F.col("prob")).alias("sampled")
    )


def mixed_documents(docs: DataFrame, features: dict[str, Column] | None = None, targets: dict[str, DataFrame] | None = None, rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: str = SEED) -> DataFrame:
    """The rows of docs that are drawn, with their columns as they are; see mix. A row stays if its cell's chance is above
    its id's draw, so texts are read where they lie and only cells are shuffled."""
    own = cell_of(docs, features)
    chances = cell_chances(docs.select(*[c.alias(d) for d, c in own.items()], n_tokens(docs["text"]).alias("tokens")), targets, rounds, temperature)
    names = [free_name(docs.columns, f"_{d}") for d in DIMS]
    prob = free_name(docs.columns, "_prob")
    cells = chances.select(*[F.col(d).alias(n) for d, n in zip(DIMS, names, strict=True)], F.col("prob").alias(prob))
    cells = F.broadcast(cells) if chances.count() <= PARTITION_CELLS else cells
    keyed = docs.select("*", *[own[d].alias(n) for d, n in zip(DIMS, names, strict=True)])
    return keyed.join(cells, names).where(draw(F.col("doc_id"), seed) < F.col(prob)).select(*docs.columns)


def oracle(table: str = "documents", rounds: int = ROUNDS, temperature: float = TEMPERATURE, seed: str = SEED) -> str:
    """The result of mix over a table as one DuckDB statement."""
    dims = ", ".join(DIMS)
    steps = [
        f"""WITH rows0 AS MATERIALIZED (SELECT doc_id, coalesce(source, '{NONE}') AS source, coalesce(lang, '{NONE}') AS lang,
  CASE WHEN contains(lower(t), 'license') THEN 'legal' WHEN (length(t) - length(translate(t, '#*$%&|<>', ''))) * 20 > length(t) THEN 'markup'
  WHEN (length(t) - length(translate(t, '0123456789', ''))) * 50 > length(t) THEN 'numeric' ELSE 'prose' END AS topic,
  len(regexp_extract_all(t, '[^ \\t\\n\\r]+'))::BIGINT AS tokens FROM (SELECT *, coalesce(text, '') AS t FROM {table}))""",
        f"cells AS MATERIALIZED (SELECT {dims}, sum(tokens)::BIGINT AS tokens FROM rows0 GROUP BY ALL)",
    ]
    for d in DIMS:
        steps.append(f"aim_{d} AS MATERIALIZED (SELECT {d}, raw / sum(raw) OVER () * (SELECT sum(tokens) FROM cells) AS aim FROM (SELECT {d}, pow(sum(tokens)::DOUBLE, {temperature}) AS raw FROM cells GROUP BY {d}))")
    last = f"(SELECT {dims}, tokens, tokens::DOUBLE AS fitted FROM cells)"
    for k in range(rounds):
        for d in DIMS:
            name = f"f{k}_{d}"
            steps.append(f"{name} AS MATERIALIZED (SELECT {dims}, tokens, fitted * coalesce(aim / nullif((sum(fitted::DECIMAL(28,9)) OVER (PARTITION BY {d}))::DOUBLE, 0), 0) AS fitted FROM {last} JOIN aim_{d} USING ({d}))")
            last = name
    off = " UNION ALL ".join(f"SELECT abs(sum(fitted::DECIMAL(28,9))::DOUBLE - any_value(aim)) AS off FROM {last} JOIN aim_{d} USING ({d}) GROUP BY {d}" for d in DIMS)
    steps.append(f"residual AS MATERIALIZED (SELECT coalesce(max(off) / nullif((SELECT sum(tokens) FROM cells), 0), 0) AS residual FROM ({off}))")
    steps.append(f"chances AS MATERIALIZED (SELECT {dims}, weight, coalesce(weight / nullif(max(weight) OVER (), 0), 0) AS prob FROM (SELECT {dims}, coalesce(fitted / nullif(tokens, 0), 0) AS weight FROM {last}))")
    return ",\n".join(steps) + f"""
SELECT doc_id, {dims}, tokens, round(weight, 6) AS weight, round(prob, 9) AS prob, round(residual, 6) AS residual,
  ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT / 281474976710656.0 < prob AS sampled FROM rows0 JOIN chances USING ({dims}), residual"""
