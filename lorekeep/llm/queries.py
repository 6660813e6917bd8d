"""The registered queries of this subpackage: thin digests over each operator's own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, chat, decontam, manifest, quality, resample, sanitise, simhash, tokencount, topk, toxicity, urlrules
from .common import sha256, ship


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_read(spark, sf_dir, "documents"), tokencount.load(tokenizer_file("piece_bpe_32k.model")))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_read(spark, sf_dir, "documents")).select("doc_id", "class_id", "is_kept", "n_links")


def op4_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sanitise.sanitise(_read(spark, sf_dir, "documents"), texts=False)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return found.select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in sanitise.KINDS],
        sha256(joined(F.filter("spans", lambda s: s["kind"] != sanitise.TERM))).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        count(sanitise.TERM).alias("n_term"),
    )


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = quality.train(docs.where(~held_out), labels.where(~held_out))
    return quality.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.load_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    return bpe.encode(_read(spark, sf_dir, "documents"), ranks, tokenizer_pattern(), decoded_col="decoded").select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256(F.col("decoded")).alias("decoded_sha256"),
    )


EXTRA_CHAT = "</s>[INST] ok [/INST]"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    extra = spark.createDataFrame(
        [(-7, 0, "user", EXTRA_CHAT), (-7, 1, "assistant", EXTRA_CHAT)], "conv_id long, turn long, role string, text string"
    )
    turns = _read(spark, sf_dir, "conversations").select(*columns).unionByName(extra)
    chats = chat.format_chats(turns.withColumn("parts", chat.text_part(F.col("text"))))
    said = chat.read_turns(F.col("formatted"))
    loss = chat.read_loss(F.col("formatted"), F.col("loss_spans"))
    each = F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.withColumn("said", said).withColumn("loss", loss).select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        sha256(F.array_join(each, "")).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        sha256(F.col("loss")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = rf"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{EXTRA_CHAT}'), (-7, 1, 'assistant', '{EXTRA_CHAT}')
), sized as (
  select *, length(regexp_replace(role, '[<\[\\]', 'xx', 'g')) + length(regexp_replace(text, '[<\[\\]', 'xx', 'g'))
    + {len(chat.TURN) + len(chat.SAYS) + len(chat.END)} as n from turns
), said as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text) as said,
    coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '') as loss,
    sum(n)::bigint as formatted_chars
  from sized group by conv_id
)
select conv_id, n_turns, sha256(said) as turns_sha256, length(loss) as loss_chars, sha256(loss) as loss_sha256, formatted_chars
from said
"""


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(urlrules.RULES, "host string, path string, action string")
    return urlrules.judge_urls(_read(spark, sf_dir, "pages"), rules)


OP8_SQL = """
with rules(rhost, rpath, action) as (values {rules}),
pages2 as (
  select page_id, url, row_number() over () as n,
    case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages
), parts as (
  select page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') as path from pages2
), ranked as (
  select p.*, rhost || rpath as rule, action,
    row_number() over (partition by n order by length(rhost || rpath) desc nulls last, rhost || rpath) as best
  from parts p left join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath)
)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from ranked where best = 1
""".replace("{rules}", ", ".join(str(r) for r in urlrules.RULES))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.quantised("embedding").alias("vector"))
    return topk.top_k(vectors, vectors.where(F.col("id") % 20 == 0), k=20)


OP9_SQL = """
with v as (
  select row_number() over () as n, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.n, q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score
  from v q join v c on q.n <> c.n where q.vec_id % 20 = 0
), ranked as (
  select query_id, row_number() over (partition by n order by score desc, vec_id)::int as rank, vec_id, score from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


#: The CRC of a text is the exclusive or of what its length and each of its bytes, by distance from the end, add to it.
OP12_SQL = """
with recursive texts as (
  select 0 as kind, row_number() over () as d, doc_id, coalesce(text, '') as text from documents
  union all
  select 1, row_number() over (), null, coalesce(text, '') from benchmark
), kept as (
  select kind, d, doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from texts
), found as (
  select kind, d, array_to_string(w[i:i + n - 1], ' ') as f from kept, range(1, 4) lens(n), unnest(range(1, len(w) - n + 2)) places(i)
), grams as (
  select f, hex(encode(f)) as h, octet_length(encode(f)) as size from (select distinct f from found)
), bytes as (
  select v, list_reduce([v::ubigint] || range(8)::ubigint[], lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::ubigint) else c >> 1 end) as c
  from range(256) r(v)
), longest as (select max(size) as size from grams
), zeros(p, v, c) as (
  select 0, v, c from bytes
  union all
  select p + 1, z.v, xor(z.c >> 8, b.c) from zeros z join bytes b on b.v = z.c & 255 where p < (select size from longest)
), ends(p, c) as (
  select 0, 4294967295::ubigint
  union all
  select p + 1, xor(e.c >> 8, b.c) from ends e join bytes b on b.v = e.c & 255 where p < (select size from longest)
), hashed as (
  select f, xor(4294967295::ubigint, xor(any_value(e.c), bit_xor(z.c))) % 10000 as b
  from grams, unnest(range(0, size)) places(i)
  join zeros z on z.p = size - 1 - i and z.v = ('0x' || substr(h, 2 * i + 1, 2))::int
  join ends e on e.p = size
  group by f
), counted as (select kind, d, b, count(*) as n from found join hashed using (f) group by all
), sums as (
  select b, coalesce(sum(n) filter (where kind = 0), 0) as s, coalesce(sum(n) filter (where kind = 1), 0) as t from counted group by b
), gains as (
  select b, floor(1000 * ln((t + 1)::double * (select sum(s) + 10000 from sums) / ((s + 1)::double * (select sum(t) + 10000 from sums))))::bigint as gain from sums
), weighed as (
  select d, sum(n)::bigint as n_features, sum(n * gain)::bigint as weight from counted join gains using (b) where kind = 0 group by d
), scored as (
  select doc_id, d, len(w) as n_words, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5) / 4294967296)))::bigint as score
  from kept left join weighed using (d) where kind = 0
), ranked as (
  select *, case when n_words >= 20 then row_number() over (partition by n_words >= 20 order by score desc, doc_id) end as place from scored
)
select doc_id, n_features, weight, score, case when place <= (select 5 * count(*) // 100 from scored where n_words >= 20) then place end as rank from ranked
"""


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    altered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    found = manifest.manifest(docs, F.when(altered, manifest.leaf_of(text=F.translate("text", "\n", ""))).otherwise(manifest.leaf_of()))
    return found.select("doc_id", "leaf", "subroot", "root", manifest.proof_digest(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


def _framed(*values: str) -> str:
    return "sha256(concat(" + ", ".join(f"case when {v} is null then '-' else octet_length(encode({v}::varchar)) || ':' || {v} end" for v in values) + "))"


#: The two trees level by level; a path has the nodes before and after at each level, those of the sources after those of the source.
OP13_SQL = f"""
with recursive marked as (
  select *, xor(list_reduce([4294967295::bigint] || flatten(list_transform(range(1, length(doc_id::varchar) + 1), lambda i: [ascii(substr(doc_id::varchar, i, 1))::bigint] || repeat([-1::bigint], 8))),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end), 4294967295::bigint) % 2 = 0 as altered from documents
), hashed as (
  select row_number() over () as n, doc_id, source, {_framed("doc_id", "source", "lang", "n_chars", "text")} as leaf,
    {_framed("doc_id", "source", "lang", "n_chars", "(case when coalesce(altered, false) then replace(text, chr(10), '') else text end)")} as found from marked
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as cnt from hashed
), tree(source, lvl, idx, digest, cnt) as (
  select source, 0, pos, leaf, cnt from placed
  union all
  select source, lvl + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (max(cnt) + 2) // 3 from tree where cnt > 1 group by source, lvl, idx // 3
), tops as (
  select source, digest as subroot, lvl as depth, row_number() over (order by source nulls first) - 1 as pos, count(*) over () as cnt from tree where cnt = 1
), upper(lvl, idx, digest, cnt) as (
  select 0, pos, subroot, cnt from tops
  union all
  select lvl + 1, idx // 3, sha256(string_agg(digest, '' order by idx)), (max(cnt) + 2) // 3 from upper where cnt > 1 group by lvl, idx // 3
), paths as materialized (
  select n, t.lvl, coalesce(string_agg(digest, '' order by idx) filter (where idx < pos // (3 ** t.lvl)::bigint), '') as before,
    coalesce(string_agg(digest, '' order by idx) filter (where idx > pos // (3 ** t.lvl)::bigint), '') as after
  from placed p join tree t on t.source is not distinct from p.source and t.cnt > 1 and t.idx // 3 = p.pos // (3 ** (t.lvl + 1))::bigint group by n, t.lvl
  union all
  select n, o.depth + u.lvl, coalesce(string_agg(digest, '' order by idx) filter (where idx < o.pos // (3 ** u.lvl)::bigint), ''),
    coalesce(string_agg(digest, '' order by idx) filter (where idx > o.pos // (3 ** u.lvl)::bigint), '')
  from placed p join tops o on o.source is not distinct from p.source join upper u on u.cnt > 1 and u.idx // 3 = o.pos // (3 ** (u.lvl + 1))::bigint group by n, o.depth + u.lvl
), folds(n, lvl, digest) as (
  select n, 0, found from hashed
  union all
  select f.n, f.lvl + 1, sha256(before || digest || after) from folds f join paths p on p.n = f.n and p.lvl = f.lvl
), ends as (select n, arg_max(digest, lvl) as folded_root from folds group by n
), proofs as (select n, string_agg(before || after, '' order by lvl) as proof from paths group by n)
select doc_id, leaf, subroot, (select digest from upper where cnt = 1) as root, sha256(coalesce(proof, '')) as proof_sha256, folded_root,
  folded_root = (select digest from upper where cnt = 1) as verified
from placed p join tops o on o.source is not distinct from p.source join ends using (n) left join proofs using (n)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_toxicity": op2_toxicity,
        "op3_near_duplicates": op3_near_duplicates,
        "op4_sanitise": op4_sanitise,
        "op5_quality": op5_quality,
        "op6_bpe": op6_bpe,
        "op7_chat": op7_chat,
        "op8_url_rules": op8_url_rules,
        "op9_top_k": op9_top_k,
        "op10_decontaminate": op10_decontaminate,
        "op11_simhash": op11_simhash,
        "op12_resample": op12_resample,
        "op13_manifest": op13_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_chat": OP7_SQL, "op8_url_rules": OP8_SQL, "op9_top_k": OP9_SQL, "op12_resample": OP12_SQL, "op13_manifest": OP13_SQL}
