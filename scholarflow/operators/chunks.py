"""Markdown documents to chapters and bounded chunks, and back."""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scholarflow.functions import text as X
from scholarflow.operators.scale import lookup_join

THRESHOLD = 2000
HEADER_NO = 0  # chapter number of the row that holds the front matter


def counter_of(make: Callable[[], Callable[[str], int]]) -> Callable[[Column], Column]:
    """A token counter from a Python callable, such as a model's own tokenizer.

    ``make`` builds the callable once per task. It is slower than the default
    counter, which is a Spark expression.
    """
    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counted = make()
        for texts in batches:
            yield texts.map(counted)

    return count


def chapter_rows(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "markdown", with_header: bool = True
) -> DataFrame:
    """(doc_id, chapter_no, text): chapters numbered from 1.

    With ``with_header`` front matter is split off and comes as chapter 0 (''
    when there is none); without, it stays part of the text.
    """
    split = X.front_matter(text) if with_header else F.struct(
        F.lit("").alias("header"), F.col(text).alias("body")
    )
    rows = F.concat(F.array(F.col("_s.header")), X.chapters("_s.body"))
    return (
        docs.where(F.col(text).isNotNull())
        .select(doc_id, split.alias("_s"))
        .select(doc_id, F.posexplode(rows).alias("chapter_no", "text"))
    )


def chunk_plan(
    chapters: DataFrame, *, threshold: int = THRESHOLD,
    counter: Callable[[Column], Column] = X.count_tokens,
) -> DataFrame:
    """Add ``n_tokens`` and ``n_parts``, the number of parts a text is cut into."""
    return chapters.withColumn("n_tokens", counter(F.col("text"))).withColumn(
        "n_parts", X.part_count("n_tokens", threshold)
    )


def chunk_rows(
    chapters: DataFrame, *, threshold: int = THRESHOLD, delimiter: str = "\n\n",
    pattern: str | None = None, counter: Callable[[Column], Column] = X.count_tokens,
) -> DataFrame:
    """(.., part_no, text): chapters cut into parts numbered from 1.

    Joining the parts of a chapter gives its text back; header rows stay whole.
    """
    keys = [c for c in chapters.columns if c != "text"]
    n = X.part_count(counter(F.col("text")), threshold)
    if "chapter_no" in keys:
        n = F.when(F.col("chapter_no") == HEADER_NO, 1).otherwise(n)
    parts = X.split_parts("text", "_n", delimiter, pattern=pattern)
    return (
        chapters.withColumn("_n", n)
        .select(*keys, F.posexplode(parts).alias("part_no", "text"))
        .withColumn("part_no", F.col("part_no") + 1)
    )


def transform_chunks(
    chunks: DataFrame, make: Callable[[], Callable[[str], str]], *, keys: list[str],
    min_length: int = 100, attempts: int = 3, tasks: int | None = None,
) -> DataFrame:
    """Apply a text-to-text callable to every chunk.

    ``make`` builds the callable once per task (a client, a model).
    Output shorter than ``min_length`` is asked for again, ``attempts`` times in
    all, then kept as it is. Blank chunks and front matter pass unchanged.
    Adds ``output``, ``status`` (ok, short, blank, error), ``tries``, ``error``;
    an error leaves ``output`` NULL and stops no other chunk.

    Rows are spread by chunk, not by document, so a long document is shared
    out among the tasks.
    """
    schema = chunks.schema
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    out += ", output string, status string, tries int, error string"
    has_header = "chapter_no" in chunks.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        apply = make()

        def one(text: str) -> tuple[str | None, str, int, str | None]:
            answer = None
            for attempt in range(1, attempts + 1):
                try:
                    answer = apply(text)
                    long_enough = len(answer) >= min_length
                except Exception as e:  # noqa: BLE001 - recorded per row
                    return None, "error", attempt, f"{type(e).__name__}: {e}"
                if long_enough:
                    return answer, "ok", attempt, None
            return answer, "short", attempts, None

        for batch in batches:
            header = batch["chapter_no"] == HEADER_NO if has_header else [False] * len(batch)
            rows = [
                (t, "blank", 0, None) if h or not t.strip() else one(t)
                for t, h in zip(batch["text"], header)
            ]
            extra = pd.DataFrame(
                rows, columns=["output", "status", "tries", "error"], index=batch.index
            )
            yield pd.concat([batch, extra], axis=1)

    spread = chunks.repartition(tasks, *keys) if tasks else chunks.repartition(*keys)
    return spread.mapInPandas(run, out)


_ANSWER = "chunk string, output string, status string, tries int, error string"


@dataclass(frozen=True)
class AnswerStore:
    """Answers to chunks below ``path``, by a hash of instruction and chunk.

    ``instruction`` names all that decides an answer besides the chunk: the prompt, the
    model and its settings. Stores of several instructions can share a path.
    """

    spark: SparkSession
    path: str
    instruction: str

    def key(self, text: str) -> Column:
        return F.sha2(F.concat(F.lit(f"{self.instruction}\0"), F.col(text)), 256)

    def read(self) -> DataFrame:
        """(chunk, output, status, tries, error), each chunk once; an answer goes before an error."""
        try:
            rows = self.spark.read.schema(_ANSWER).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            rows = self.spark.createDataFrame([], _ANSWER)
        rest = F.struct("output", "status", "tries", "error")
        # the least of several answers, so that every reader sees the same
        best = F.min_by(rest, F.struct(F.col("output").isNull(), "status", "output", "tries"))
        return rows.groupBy("chunk").agg(best.alias("_a")).select("chunk", "_a.*")


def transform_resumable(
    chunks: DataFrame, make: Callable[[], Callable[[str], str]], store: AnswerStore, *,
    min_length: int = 100, attempts: int = 3, tasks: int | None = None, waves: int = 8,
) -> DataFrame:
    """``transform_chunks`` that asks for nothing twice: not for equal chunks, and not after a restart.

    Chunks without a stored answer are asked for in ``waves`` by their hash, and
    each wave is stored when it ends: a run that is killed loses its unfinished
    wave only, and the next one asks for what is missing. Errors are asked for
    again by the next run, short answers are not. Blank chunks and front matter
    pass unchanged and are not stored. One run at a time writes to a store.
    """
    is_text = F.col("text").rlike(r"\S")
    if "chapter_no" in chunks.columns:
        is_text &= F.col("chapter_no") != HEADER_NO
    keyed = chunks.withColumn("chunk", F.when(is_text, store.key("text")))
    wanted = keyed.where("chunk is not null").groupBy("chunk").agg(F.first("text").alias("text"))
    known = store.read().where("output is not null").select("chunk")
    wave = F.pmod(F.xxhash64("chunk"), F.lit(waves)).alias("wave")
    todo = f"{store.path.rstrip('/')}-todo/{uuid.uuid4().hex}"
    wanted.join(known, "chunk", "left_anti").select("chunk", "text", wave).write.partitionBy("wave").parquet(todo)
    missing = store.spark.read.schema("chunk string, text string, wave int").parquet(todo)
    for n in range(waves):
        asked = transform_chunks(
            missing.where(F.col("wave") == n).select("chunk", "text"), make, keys=["chunk"],
            min_length=min_length, attempts=attempts, tasks=tasks,
        )
        asked.drop("text").write.mode("append").parquet(store.path)
    found = lookup_join(keyed, store.read(), ["chunk"], hit="_a")
    passed = F.col("chunk").isNull()
    return found.select(
        *chunks.columns,
        F.when(passed, F.col("text")).otherwise(F.col("_a.output")).alias("output"),
        F.when(passed, F.lit("blank")).otherwise(F.col("_a.status")).alias("status"),
        F.when(passed, F.lit(0)).otherwise(F.col("_a.tries")).alias("tries"),
        F.col("_a.error").alias("error"),
    )


def assemble(
    chunks: DataFrame, *, doc_id: str = "doc_id", text: str = "output"
) -> DataFrame:
    """(doc_id, n_chunks, markdown) from transformed chunks.

    Parts are joined by a blank line, every chapter starts after one, and front
    matter comes first. A document's chunks come from one input row, which
    bounds the group. A chunk without output leaves its place empty.
    """
    ordered = F.sort_array(F.collect_list(
        F.struct("chapter_no", "part_no", F.coalesce(text, F.lit("")).alias("t"))
    ))
    piece = lambda c: (
        F.when(c["chapter_no"] == HEADER_NO, F.when(c["t"] != "", F.concat(c["t"], F.lit("\n\n"))).otherwise(""))
        .otherwise(F.concat(F.lit("\n\n"), c["t"]))
    )
    return chunks.groupBy(doc_id).agg(
        F.count_if(F.col("chapter_no") != HEADER_NO).alias("n_chunks"),
        F.array_join(F.transform(ordered, piece), "").alias("markdown"),
    )


def transform_in_place(
    docs: DataFrame, fn: Callable[[Column], Column], *, doc_id: str = "doc_id",
    text: str = "markdown", threshold: int = THRESHOLD, delimiter: str = "\n\n",
    pattern: str | None = None, with_header: bool = True,
) -> DataFrame:
    """The whole job for a transform that is a Spark expression.

    Split, cut, transform and reassemble inside each row: no shuffle at all.
    Returns (doc_id, n_chunks, markdown), equal to ``assemble`` of the chunks.
    """
    split = X.front_matter(text) if with_header else F.struct(
        F.lit("").alias("header"), F.col(text).alias("body")
    )
    n = X.sql_bind(X.count_tokens_sql("t_"), "k_", X.part_count_sql("k_", threshold))
    cut = F.call_function(
        "transform", X.chapters("_s.body"),
        F.expr(f"x_ -> {X.split_parts_sql('x_', n, delimiter, pattern)}"),
    )
    head = F.when(F.col("_s.header") != "", F.concat("_s.header", F.lit("\n\n"))).otherwise("")
    done = F.transform("_parts", lambda ps: F.concat(
        F.lit("\n\n"), F.array_join(F.transform(ps, fn), "\n\n")
    ))
    return (
        docs.where(F.col(text).isNotNull())
        .select(doc_id, split.alias("_s"))
        .select(doc_id, "_s", cut.alias("_parts"))
        .select(
            doc_id,
            F.size(F.flatten("_parts")).cast("bigint").alias("n_chunks"),
            F.concat(head, F.array_join(done, "")).alias("markdown"),
        )
    )


def observed(df: DataFrame, name: str, *, text: str = "text") -> tuple[DataFrame, Observation]:
    """``df`` and the counts (rows, characters) that a job over it collects on
    the way, without a pass of their own."""
    seen = Observation(name)
    counted = df.observe(
        seen, F.count(F.lit(1)).alias("rows"), F.sum(F.length(text)).alias("characters")
    )
    return counted, seen


def compare_structure(
    source: DataFrame, output: DataFrame, *, doc_id: str = "doc_id", text: str = "markdown"
) -> DataFrame:
    """(doc_id, source_chapters, output_chapters, same): chapter counts of the
    texts before and after a transform, counting every '## ' heading."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        body = X.front_matter(text)["body"]
        return df.select(doc_id, F.size(X.chapters(body)).alias(name))

    left, right = counted(source, "source_chapters"), counted(output, "output_chapters")
    return left.join(right, doc_id, "left").withColumn(
        "same", F.coalesce(F.col("source_chapters") == F.col("output_chapters"), F.lit(False))
    )


def common_sequence(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places (i, j) of a longest common subsequence of two lists.

    Only places of equal values are looked at, and equal ends are set aside
    first, so the work follows the number of matches between them.
    """
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    places: dict[str, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # the smallest last place in b of a common subsequence of each length
    last: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            node = (i, j, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(node)
            else:
                ends[k], last[k] = j, node
    middle, node = [], last[-1] if last else None
    while node:
        middle.append((node[0], node[1]))
        node = node[2]
    ending = [(len(a) - k, len(b) - k) for k in range(tail, 0, -1)]
    return [(k, k) for k in range(head)] + middle[::-1] + ending


def align(source: list[str], output: list[str]) -> list[tuple[str, int | None, int | None]]:
    """(status, source place, output place) of every heading of the two lists.

    kept headings are a longest common subsequence. One that is left on both
    sides has moved; else it is missing or extra.
    """
    kept = common_sequence(source, output)
    mine, theirs = {i for i, _ in kept}, {j for _, j in kept}
    spare: dict[str, list[int]] = {}
    for j in range(len(output) - 1, -1, -1):
        if j not in theirs:
            spare.setdefault(output[j], []).append(j)
    rows: list[tuple[str, int | None, int | None]] = [("kept", i, j) for i, j in kept]
    for i in range(len(source)):
        if i not in mine:
            rows.append(("moved", i, spare[source[i]].pop()) if spare.get(source[i]) else ("missing", i, None))
    rows += [("extra", None, j) for places in spare.values() for j in places]
    return rows


_ALIGNED = "array<struct<status:string,source_no:int,output_no:int>>"


def align_headings(
    source: DataFrame, output: DataFrame, *, doc_id: str = "doc_id", text: str = "markdown"
) -> DataFrame:
    """(doc_id, status, source_no, output_no, heading): how a transform treated the '## ' headings of a text.

    kept headings are a longest common sequence of both texts; the others are
    moved, missing or extra. Places count from 0. A source without output has all
    its headings missing; outputs without source are left out, and so are
    texts that are NULL. Ids are taken as unique.
    """
    @F.arrow_udf(_ALIGNED)
    def aligned(a: pa.Array, b: pa.Array) -> pa.Array:
        names = ("status", "source_no", "output_no")
        rows = [[dict(zip(names, r)) for r in align(x or [], y or [])] for x, y in zip(a.to_pylist(), b.to_pylist())]
        kind = pa.struct([("status", pa.string()), ("source_no", pa.int32()), ("output_no", pa.int32())])
        return pa.array(rows, pa.list_(kind))

    def headed(df: DataFrame, name: str) -> DataFrame:
        marked = F.filter(X.chapters(X.front_matter(text)["body"]), lambda c: F.startswith(c, F.lit("##")))
        titles = F.transform(marked, lambda c: X.strip(F.regexp_extract(c, "^##([^\n]*)", 1)))
        return df.where(F.col(text).isNotNull()).select(doc_id, titles.alias(name))

    both = headed(source, "_mine").join(headed(output, "_theirs"), doc_id, "left")
    rows = both.select("*", aligned("_mine", "_theirs").alias("_rows"))
    heading = F.coalesce(F.expr("get(_mine, r.source_no)"), F.expr("get(_theirs, r.output_no)"))
    return rows.select(doc_id, "_mine", "_theirs", F.explode("_rows").alias("r")).select(
        doc_id, "r.status", "r.source_no", "r.output_no", heading.alias("heading")
    )
