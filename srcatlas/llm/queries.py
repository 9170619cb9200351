"""The registered queries of this folder: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from srcatlas.llm.common import table, whole_text
from srcatlas.llm.exact import exact_duplicates
from srcatlas.llm.html_text import extracted
from srcatlas.llm.language import page_languages
from srcatlas.llm.mixing import mixture
from srcatlas.llm.packing import packed
from srcatlas.llm.pii import personal_data
from srcatlas.llm.prefix_trie import prefix_trie
from srcatlas.llm.quality import quality_rules
from srcatlas.llm.resampling import importance_ranks
from srcatlas.llm.secrets import secret_scan
from srcatlas.llm.sharding import bounded_shards
from srcatlas.llm.simhash import near_duplicates
from srcatlas.llm.tool_calls import link_tool_calls

TOKENIZER = "byte_bpe_50k.tiktoken"

#: What the tools of the conversations take: a prompt of some length and its place.
_PLACE = {"turn": {"type": "integer", "minimum": 0}}


def _takes(**prompt) -> dict:
    return {"type": "object", "properties": {"prompt": {"type": "string", **prompt}, **_PLACE}, "required": ["prompt", "turn"], "additionalProperties": False}


SCHEMAS = {"answer": _takes(minLength=100), "lookup": _takes(minLength=1, maxLength=400), "setup": _takes(minLength=1)}


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), F.sha2(whole_text(), 256).alias("text_sha256"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bounded_shards(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def calls_and_results(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every turn that is not an assistant's is a call with its text as arguments; an assistant's turn is the result of the call
    one turn before it.

    System turns call ``setup``; the others call ``answer`` in every second conversation and turn, and else ``lookup``, whatever
    their text.  A call waits for the turn two before and for the first of the conversation.
    """
    spot = lambda turn: F.concat_ws("-", "conv_id", turn.cast("string"))
    role, turn = F.coalesce("role", F.lit("")), F.col("turn")
    name = F.when(role == "system", "setup").when((F.col("conv_id") + F.floor(turn / 2)) % 2 == 0, "answer").otherwise("lookup")
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), "turn"))
    asked = turns.where(role != "assistant")
    calls = asked.select("conv_id", spot(turn).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"))
    before = F.array(spot(turn - 2), spot(F.lit(0)))
    waits = asked.where("turn > 0").select("conv_id", spot(turn).alias("call_id"), F.explode(before).alias("after"))
    results = turns.where(role == "assistant").select("conv_id", spot(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results, waits


def op6_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, waits = calls_and_results(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, SCHEMAS, waits)


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_languages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_ranks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash, op2_exact_dedup, op3_pii, op4_sharding, op5_quality, op6_tool_calls, op7_html_text, op8_packing, op9_mixing, op10_language,
        op11_secrets, op12_resampling, op13_prefix_trie,
    )
}
