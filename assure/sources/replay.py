"""Answers kept by the hash of what was asked: recorded once, replayed in later runs; a miss is an error."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import exists, written

RESPONSE = (
    "struct<text:string,calls:array<struct<name:string,args:map<string,string>>>,submit:struct<outcome:string,confidence_bps:int,hypotheses:array<string>,chosen:int,"
    "evidence:array<struct<ref:string,role:string>>,tried:string,resolve:string,trivial:boolean>,tokens_in:bigint,tokens_out:bigint>"
)
#: requests (key, turn, request and columns of their own) to the same rows with response, null where there is none.
Client = Callable[[DataFrame], DataFrame]


class NoAnswer(Exception):
    """A request without a recorded or scripted answer."""


def prompt_hash(prompts: Mapping[str, str]) -> str:
    """sha256 over names and texts of the prompts in order of name, each ended by a NUL."""
    import hashlib

    own = hashlib.sha256()
    for name in sorted(prompts):
        own.update(name.encode() + b"\0" + prompts[name].encode() + b"\0")
    return own.hexdigest()


def request_key(prompt: str, model: str, transcript) -> Column:
    """The key of a request: prompts, model and the digest of all that was said before."""
    return F.sha2(F.concat_ws("\n", F.lit(prompt), F.lit(model), F.col(transcript)), 256)


def scripted(script: DataFrame) -> Client:
    """Answers from a table: key, turn, response; the first of repeated rows. It is made once and written, not in each round."""
    once = written(script.select("key", F.col("turn").cast("int").alias("turn"), F.to_json("response").alias("_r")).groupBy("key", "turn").agg(F.min("_r").alias("_r")))
    return lambda requests: requests.join(once, ["key", "turn"], "left").withColumn("response", F.from_json("_r", RESPONSE)).drop("_r")


def _stored(spark: SparkSession, store: str) -> DataFrame:
    if exists(spark, store):
        return spark.read.schema("request string, answer string").parquet(store)
    return spark.createDataFrame([], "request string, answer string")


def replayed(spark: SparkSession, store: str) -> Client:
    """Answers from the store only."""
    return lambda requests: requests.join(_stored(spark, store), "request", "left").withColumn("response", F.from_json("answer", RESPONSE)).drop("answer")


def recorded(spark: SparkSession, store: str, inner: Client) -> Client:
    """Answers from the store, and for requests that are not in it from inner, which are added to it: nothing is asked twice."""

    def ask(requests: DataFrame) -> DataFrame:
        new = inner(requests.join(_stored(spark, store), "request", "left_anti")).where("response IS NOT NULL")
        new = written(new.groupBy("request").agg(F.min(F.to_json("response")).alias("answer")))
        if not new.isEmpty():
            new.write.mode("append").parquet(store)
        return replayed(spark, store)(requests)

    return ask
