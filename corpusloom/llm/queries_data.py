"""The queries of sharding, chat formatting, line dedup and exact dedup, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, line_dedup, sharding
from .common import table, written


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts of all documents: which row of each group stays."""
    found = exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP9_SQL = r"""
with d as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id is not distinct from min(doc_id) over w as kept, text_sha256
from d window w as (partition by text_sha256)
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts stay together."""
    placed = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


CONTROL_TURN = "</s>[INST] ok [/INST]"


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one made of control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TURN), (-1, 1, "assistant", CONTROL_TURN)], "conv_id long, turn long, role string, text string")
    made = written(chat.segments(turns.unionByName(probe)), "segments")
    return chat.digests(made, chat.examples(made))


OP6_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *, length(regexp_replace(text, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<ROLE>>|<</ROLE>>)', '\\\1\2', 'g')) as body,
            length(regexp_replace(role, '(\\*)(<s>|</s>|\[INST\]|\[/INST\]|<<ROLE>>|<</ROLE>>)', '\\\1\2', 'g')) as name from t
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(body + case role when 'user' then 18 when 'assistant' then 9 else 28 + name end)::bigint as formatted_chars,
       count(*) filter (where role = 'assistant') as n_examples
from e group by conv_id
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines whose key stands in ten documents or more."""
    kept = line_dedup.without_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP8_SQL = r"""
with l as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)
), k as (
  select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), f as (
  select key from k where length(key) >= 1 group by key having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(f.key) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.key is null), '')) as kept_sha256
from k left join f on k.key = f.key group by doc_id
"""

QUERIES = {"op5_sharding": op5_sharding, "op6_chat_formatting": op6_chat_formatting, "op8_line_dedup": op8_line_dedup, "op9_exact_dedup": op9_exact_dedup}
ORACLES = {"op6_chat_formatting": OP6_SQL, "op8_line_dedup": OP8_SQL, "op9_exact_dedup": OP9_SQL}
