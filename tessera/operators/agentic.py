"""Iterative retrieval: decompose, search all open questions at once, pool, answer, check, repeat."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import json_check, json_list
from ..models import Llm, complete
from ..sources.shared import materialise

MAX_ITERATIONS, MAX_QUESTIONS, MAX_GAPS, POOL_KEY = 3, 4, 3, 80


def per_question(k: int, questions: int) -> int:
    return max(3, k // max(questions, 1) + 2)


def rank_pool(hits: DataFrame, k: int) -> DataFrame:
    """Best hit of each content start (80 characters), then the k best of all; earlier queries win ties."""
    first = Window.partitionBy(F.substring("content", 1, POOL_KEY)).orderBy(F.desc(F.round("score", 9)), "query_id", "key")
    best = hits.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "rank")
    order = [F.desc(F.round("score", 9)), F.col("query_id"), F.col("key")]
    return best.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def decompose(questions: DataFrame, model: Llm, text: str = "query") -> DataFrame:
    """``sub_questions``: at most four of more than five characters, else the question itself."""
    reply = complete(F.concat(F.lit("TASK decompose\n"), F.col(text)), model)
    got = F.filter(F.slice(json_list(reply), 1, MAX_QUESTIONS), lambda q: F.length(q) > 5)
    return questions.withColumn("sub_questions", F.when(F.size(got) > 0, got).otherwise(F.array(F.col(text))))


def self_check(answers: DataFrame, model: Llm) -> DataFrame:
    prompt = F.concat(F.lit("TASK check\nQuestion: "), F.col("query"), F.lit("\nAnswer: "), F.substring("answer", 1, 1500))
    return answers.withColumn("check", json_check(complete(prompt, model)))


def rank_pools(pool: DataFrame, k: int) -> DataFrame:
    """``rank_pool`` inside each question: pool(query_id, order, key, content, score) -> the k best, with rank."""
    first = Window.partitionBy("query_id", F.substring("content", 1, POOL_KEY)).orderBy(F.desc(F.round("score", 9)), "order", "key")
    best = pool.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "order", "key")
    return best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def run_all(questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], generate: Callable[[DataFrame], DataFrame], model: Llm, k: int = 7, max_iterations: int = 2) -> DataFrame:
    """The loop for all questions at once: ``(query_id, answer, iterations, complete, confidence)``.

    An iteration searches every open question's parts in one batch, pools, answers and checks; questions
    that are incomplete with gaps go on. Nothing but the number of open questions reaches the driver.
    """
    if not 1 <= max_iterations <= MAX_ITERATIONS:
        raise ValueError(f"max_iterations must be between 1 and {MAX_ITERATIONS}")
    questions = questions.select("query_id", "query")
    state = questions.select("query_id", F.lit("").alias("answer"), F.lit(0).cast("long").alias("iterations"), F.lit(False).alias("complete"), F.lit(0.0).alias("confidence"))
    open_, pool = materialise(decompose(questions, model).select("query_id", F.posexplode("sub_questions").alias("pos", "part"))), None
    for i in range(max_iterations):
        name = F.concat_ws("#", F.col("query_id").cast("string"), F.col("pos").cast("string"))
        parts = open_.withColumn("_part", name)
        most = F.greatest(F.lit(3), F.floor(F.lit(k) / F.greatest(F.count("*"), F.lit(1))) + 2)
        allowed = open_.groupBy("query_id").agg(most.alias("_most"))
        hits = search(parts.select(F.col("_part").alias("query_id"), F.col("part").alias("query")), max(3, k + 2)).select(F.col("query_id").alias("_part"), "rank", "key", "content", "score")
        found = hits.join(parts.select("_part", "query_id", (F.col("pos") + 100 * i).alias("order")), "_part").join(allowed, "query_id").where("rank <= _most")
        found = found.select("query_id", "order", "key", "content", "score")
        pool = materialise(found if pool is None else pool.unionByName(found))
        ranked = rank_pools(pool, k).join(open_.select("query_id").distinct(), "query_id", "left_semi")
        context = ranked.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]).alias("context"))
        checked = self_check(generate(questions.join(context, "query_id")), model)
        answered = materialise(checked.select("query_id", "answer", F.lit(i + 1).cast("long").alias("iterations"), "check.complete", "check.confidence", "check.gaps"))
        state = state.join(answered.select("query_id"), "query_id", "left_anti").unionByName(answered.drop("gaps"))
        open_ = materialise(answered.where("not complete").select("query_id", F.posexplode(F.slice("gaps", 1, MAX_GAPS)).alias("pos", "part")))
        if not open_.limit(1).count():
            break
    return state


@dataclass
class Run:
    query: str
    answer: str = ""
    sub_questions: list[str] = field(default_factory=list)
    iterations: list[dict] = field(default_factory=list)
    complete: bool = False
    confidence: float = 0.0


def run(spark: SparkSession, query: str, search: Callable[[DataFrame, int], DataFrame], generate: Callable[[DataFrame, DataFrame], DataFrame], model: Llm, k: int = 7, max_iterations: int = 2) -> tuple[Run, DataFrame | None]:
    """The loop for one question: (log, sources).

    search(queries(query_id, query), k) gives hits with query_id, key, content, score; it runs once an
    iteration over all open questions. The driver holds the question, the answer and the log only.
    """
    if not 1 <= max_iterations <= MAX_ITERATIONS:
        raise ValueError(f"max_iterations must be between 1 and {MAX_ITERATIONS}")
    question = spark.createDataFrame([(query,)], "query string")
    log = Run(query, sub_questions=decompose(question, model).first()["sub_questions"])
    open_questions, pool, ranked = log.sub_questions, None, None
    for i in range(max_iterations):
        asked = spark.createDataFrame([(i * 100 + j, q) for j, q in enumerate(open_questions)], "query_id long, query string")
        hits = search(asked, per_question(k, len(open_questions))).select("query_id", "key", "content", "score")
        pool = hits if pool is None else pool.unionByName(hits)
        ranked = rank_pool(pool, k)
        used = ranked.count()
        if not used:
            break
        answered = self_check(generate(question, ranked), model).first()
        log.answer, check = answered["answer"], answered["check"]
        log.complete, log.confidence = check["complete"], check["confidence"]
        log.iterations.append({"iteration": i + 1, "queries": list(open_questions), "chunks_used": used, "complete": check["complete"], "confidence": check["confidence"], "gaps": list(check["gaps"])})
        if check["complete"] or not check["gaps"]:
            break
        open_questions = list(check["gaps"])[:MAX_GAPS]
    return log, ranked
