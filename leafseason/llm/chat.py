"""Preference formatting of conversations.

Chosen and rejected conversations of a pair share a prompt: their longest common prefix of turns (role and text equal).
The prompt is rendered once; what follows is rendered for each side as its completion, with the spans of the completion
that count for the loss: the texts and end marks of assistant turns, as half-open character ranges.

Turns are ordered by turn, role and text, nulls first; null roles and texts are rendered as empty. A pair whose one side
is missing has that side's columns null and no common turns; a side that is wholly prompt has an empty completion without
spans. Repeated rows are turns of their own. A conversation is one row of the result, as a document is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(MIDDLE), turn["text"], F.lit(CLOSE))


def threads(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, turns): the ordered turns of each conversation."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return conversations.groupBy(F.col(conv_id).alias("id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))


def _spans(turns: Column) -> Column:
    """Ranges of the assistant turns, counted from the completion's start, as start-end joined by commas."""

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(t["role"]) + len(OPEN) + len(MIDDLE)
        end = begin + F.length(t["text"]) + len(CLOSE)
        found = F.when(t["role"] == "assistant", F.array(F.concat(begin.cast("string"), F.lit("-"), end.cast("string")))).otherwise(F.array().cast("array<string>"))
        return F.struct(end.alias("at"), F.concat(acc["found"], found).alias("found"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["found"], ","))


def preference_pairs(conversations: DataFrame, pairs: DataFrame, **names: str) -> DataFrame:
    """One row for each of pairs (pair_id, chosen_id, rejected_id): n_common, prompt, and each side's completion and spans."""
    turns = threads(conversations, **names)
    chosen, rejected = (turns.select(F.col("id").alias(f"{k}_id"), F.col("turns").alias(k)) for k in ("chosen", "rejected"))
    met = pairs.select("pair_id", "chosen_id", "rejected_id").join(chosen, "chosen_id", "left").join(rejected, "rejected_id", "left")
    same = lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False))
    agree = F.zip_with("chosen", "rejected", same)
    first = F.array_position(agree, F.lit(False))
    common = F.coalesce(F.when(first == 0, F.size(agree)).otherwise(first - 1), F.lit(0)).cast("int")
    met = met.withColumn("n_common", common)
    join = lambda t: F.array_join(F.transform(t, rendered), "")
    rest = lambda k: F.slice(k, F.col("n_common") + 1, F.greatest(F.size(k) - F.col("n_common"), F.lit(0)))
    out = [F.coalesce(join(F.slice("chosen", 1, F.col("n_common"))), F.lit("")).alias("prompt")]
    out += [join(rest(k)).alias(k) for k in ("chosen", "rejected")] + [_spans(rest(k)).alias(f"{k}_spans") for k in ("chosen", "rejected")]
    return met.select("pair_id", "chosen_id", "rejected_id", F.col("n_common").cast("long").alias("n_common"), *out)


def neighbour_pairs(conversations: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Pairs for a table without preferences: of ids 2k and 2k + 1 the even one is chosen; null ids make no pair."""
    ids = conversations.select(F.floor(F.col(conv_id) / 2).cast("long").alias("pair_id")).where("pair_id is not null").distinct()
    return ids.select("pair_id", (F.col("pair_id") * 2).alias("chosen_id"), (F.col("pair_id") * 2 + 1).alias("rejected_id"))


SQL = f"""
with t as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, floor(conv_id / 2)::bigint pair_id,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) rn from conversations where conv_id is not null),
p as (select distinct pair_id from t),
firsts as (select pair_id, min(rn) bad from (
    select pair_id, rn from t group by pair_id, rn having count(*) < 2 or min(role) <> max(role) or min(text) <> max(text)) group by pair_id),
ends as (select pair_id, max(rn) most from t group by pair_id),
c as (select p.pair_id, coalesce(bad - 1, most)::bigint n_common from p left join firsts using (pair_id) join ends using (pair_id)),
r as (select t.*, n_common, conv_id % 2 as side, '{OPEN}' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as shown from t join c using (pair_id)),
s as (select *, coalesce(sum(length(shown)) over (partition by conv_id order by rn rows between unbounded preceding and 1 preceding), 0) as before from r where rn > n_common),
done as (select conv_id, string_agg(shown, '' order by rn) body,
    string_agg(case when role = 'assistant' then (before + length(role) + {len(OPEN) + len(MIDDLE)})::bigint || '-' || (before + length(shown))::bigint end, ',' order by rn) spans from s group by conv_id),
prompts as (select pair_id, string_agg(shown, '' order by rn) prompt from r where rn <= n_common and side = 0 group by pair_id),
has as (select distinct conv_id from t)
select c.pair_id, c.pair_id * 2 as chosen_id, c.pair_id * 2 + 1 as rejected_id, n_common, coalesce(prompt, '') as prompt,
    case when hc.conv_id is not null then coalesce(dc.body, '') end as chosen, case when hr.conv_id is not null then coalesce(dr.body, '') end as rejected,
    case when hc.conv_id is not null then coalesce(dc.spans, '') end as chosen_spans, case when hr.conv_id is not null then coalesce(dr.spans, '') end as rejected_spans
from c left join prompts using (pair_id) left join has hc on hc.conv_id = c.pair_id * 2 left join has hr on hr.conv_id = c.pair_id * 2 + 1
left join done dc on dc.conv_id = c.pair_id * 2 left join done dr on dr.conv_id = c.pair_id * 2 + 1
"""
