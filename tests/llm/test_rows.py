"""Row-wise operators: token counts, BPE, chat formatting, personal data, edge cases."""

import math
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import bpe, chat, sanitise, tokencount

TEXTS = [
    None, "", " ", "  ", "   a", "a   ", "a \n b\n  c", "foo\n \nbar", "it's  'll don't", "a" * 3000, "1 22  333 !!! ...",
    "x \t\ty", "é  ñ ▁ ▁▁ a", "日本語 テキスト  🙂🙂 a", "a\n\n\nb   ", "\r\n a", "    b", "same", "same",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "x", 2), (0, "again", "y", 3)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, row int")


def test_token_counts_equal_a_unigram_tokenizer(spark, odd):
    from tokenizers import Tokenizer, models

    model = tokencount.load(public_tokenizers.path("piece_bpe_32k.model"))
    vocab = [("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *model.pieces]
    judge = Tokenizer(models.Unigram(vocab, 0, True))
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in tokencount.count_tokens(odd, model).collect())
    count = lambda t: len(judge.encode("▁" + t.replace(" ", "▁")).ids) if t else 0
    want = sorted((r.doc_id is None, r.doc_id or 0, count(r.text or "")) for r in odd.collect())
    assert got == want


def test_token_counts_of_empty_tables_and_long_texts(spark, odd):
    model = tokencount.load(public_tokenizers.path("piece_bpe_32k.model"))
    assert tokencount.count_tokens(odd.where("false"), model).count() == 0
    rows = [(1, "the same words " * 50_000, "x"), (2, "the same words " * 50_000, "x"), (3, "the same words ", "x")]
    out = tokencount.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), model).collect()
    one, two, short = (r.n_tokens for r in sorted(out, key=lambda r: r.doc_id))
    assert one == two and abs(one - 50_000 * short) <= 50_000


def test_bpe_equals_tiktoken_and_round_trips(spark, odd):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    judge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = bpe.decode(bpe.encode(odd, ranks, public_tokenizers.PATTERN), ranks).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), bytes(r.decoded)) for r in out)
    want = sorted((r.doc_id is None, r.doc_id or 0, judge.encode_ordinary(r.text or ""), (r.text or "").encode()) for r in odd.collect())
    assert got == want
    fused = bpe.encode(odd, ranks, public_tokenizers.PATTERN, decoded_col="raw").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids), bytes(r.raw)) for r in fused) == want
    empty = odd.where("false")
    assert bpe.decode(bpe.encode(empty, ranks, public_tokenizers.PATTERN), ranks).count() == 0
    unknown = spark.createDataFrame([([1, -5, 10**8, None],), (None,)], "ids array<int>")
    plain = [bytes(r.decoded) for r in bpe.decode(unknown, ranks).collect()]
    assert plain == [judge.decode_bytes([1]), b""]


def test_bpe_blocks_may_end_anywhere(spark, odd):
    import tiktoken

    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    judge = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(11)
    long = "".join(rng.choice(["word", "Ünï", " ", "  ", "\n", "\u00a0", "\x1c", " 12", "!?", "\u3000x", "日本"]) for _ in range(60_000))
    rows = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(77, long), (78, long), (79, "z" * 200_000)], "doc_id long, text string"))
    want = sorted((r.doc_id is None, r.doc_id or 0, judge.encode_ordinary(r.text or "")) for r in rows.collect())
    for size in (1, 40, 4000, 10**9):
        out = bpe.encode(rows.coalesce(2), ranks, public_tokenizers.PATTERN, block_bytes=size).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, list(r.ids)) for r in out) == want


def test_bpe_reads_the_texts_once(spark, odd):
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    out = bpe.encode(odd, ranks, public_tokenizers.PATTERN)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan.split("== Initial Plan ==")[0]


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text: str) -> list:
    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")),
                "card": 12 <= len(digits) <= 19 and sanitise.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), i, m.end()))
    return [(list(PATTERNS)[i], a, b) for a, i, b in sorted(out)]


def test_base_spans_equal_the_plain_patterns():
    rng = random.Random(7)
    for alphabet, n in (("0123459..@@ab-+ () %\n1é", 6000), ("0123456789 -", 3000), ("01.", 2000), ("+12 ().-", 2000)):
        for _ in range(n):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert sanitise.base_spans(text) == plain_spans(text), text
    assert sanitise.base_spans("1" * 200_000) == [] and sanitise.base_spans("a" * 200_000) == []


def test_terms_that_disclose_an_entity_are_replaced(spark):
    mail = "eve@example.com"
    docs = [(i, f"Zorblax number{i} wrote to {mail} the day", "k") for i in range(4)] + [(10 + i, f"the day and number{i}", "k") for i in range(20)]
    docs += [(99, None, None), (None, "the day", "k"), (98, "", "k")]
    df = spark.createDataFrame(docs, "doc_id long, text string, sanitised string")
    out = {(r.doc_id): r for r in sanitise.sanitise(df).collect()}
    assert len(out) == len(docs)
    assert out[0].sanitised == " number0   [EMAIL] the day"  # Zorblax, wrote and to occur only with the entity
    assert [s.kind for s in out[0].spans] == ["term", "term", "term", "email"]
    assert out[10].sanitised == "the day and number0" and out[99].sanitised == "" and out[None].sanitised == "the day"
    copies = spark.createDataFrame([(i, f"Zorblax wrote to {mail}") for i in range(9)], "doc_id long, text string")
    assert all(r.sanitised == "Zorblax wrote to [EMAIL]" for r in sanitise.sanitise(copies).collect())  # one text proves nothing
    assert sanitise.sanitise(df.where("false")).count() == 0


@pytest.mark.parametrize("confidence", [0.05, 0.5])
@pytest.mark.parametrize("least", [-9.0, 0.3, 0.75])
def test_disclosures_equal_their_definition(spark, least, confidence):
    rng = random.Random(5)
    values = [f"m{i}@d{i % 3}.com" for i in range(6)] + [f"10.0.{i % 2}.{i}" for i in range(6)] + [f"+4930{i}23456{i}" for i in range(4)] + ["4111 1111 1111 1111"]
    docs = [" , ".join([*rng.sample([f"t{i}" for i in range(30)], 6), *rng.sample(values, rng.choice([0, 0, 1, 1, 2]))]) for _ in range(300)]
    docs += docs[:7] * 3 + ["", "t1"] + [f"k9 {values[0]} x{i}" for i in range(4)] + ["k9 alone"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    counts = sanitise.term_counts(df)
    frequent = sanitise.frequent_terms(counts, 60)
    assert 0 < frequent.count() <= 60
    out = sanitise.disclosures(df, sanitise._found(df, "text"), counts, frequent, least=least, confidence=confidence).collect()
    wider = lambda v: {
        f"email:{v}": "@" in v, f"domain:{v.rpartition('@')[2]}": "@" in v, f"local:{v.partition('@')[0]}": "@" in v, f"ip:{v}": v[:3] == "10.", f"block:{v.rpartition('.')[0]}": v[:3] == "10.",
        f"phone:{v[1:]}": v[0] == "+", f"code:{v[1:6]}": v[0] == "+", "card:4111111111111111": v[0] == "4", "issuer:411111": v[0] == "4",
    }
    entities = [{e for v in values if v in t.split() or (v[0] == "4" and v in t) for e, own in wider(v).items() if own} for t in docs]
    words, n, want = [set(re.findall(r"\b[tkx]\d+\b|alone", t)) for t in docs], len(docs), {}
    for e in set().union(*entities):
        for term in set().union(*words):
            both = [t for t, own, es in zip(docs, words, entities) if e in es and term in own]
            n_term, n_e = sum(term in own for own in words), sum(e in es for es in entities)
            if len(set(both)) >= 3 and len(both) >= confidence * n_term:
                told = math.log(len(both) * n / (n_e * n_term)) / math.log(n / n_e)
                if told >= least:
                    want[e, term] = told
    got = {(r.entity, r.term): r.disclosure for r in out}
    assert want and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_spans_of_repeated_rows_ties_and_long_texts(spark):
    text = "call +1 (2) 345-678-901 or 1.2.3.4 " * 4000
    rows = [(1, text), (1, text), (2, "+12345678901.1.1.1@x.y.z")]  # spans of several kinds overlap
    found = sanitise.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    base = lambda r: [(s.kind, s.start, s.end) for s in r.spans if s.kind != sanitise.TERM]
    assert sorted((r.doc_id, base(r)) for r in found) == sorted((i, plain_spans(t)) for i, t in rows)


def test_words_beside_an_entity_of_one_text_stay(spark):
    docs = [(0, "Zorblax wrote to eve@example.com the day")] + [(1 + i, f"the day he wrote to n{i}") for i in range(99)]
    out = {r.doc_id: r for r in sanitise.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0].sanitised == "Zorblax wrote to [EMAIL] the day"  # one text says nothing of the pair
    assert out[1].sanitised == "the day he wrote to n0"


def test_terms_are_told_by_the_levels_of_single_values(spark):
    docs = [(i, f"mail{i} from Quuxcorp: p{i}@quux.example") for i in range(5)] + [(10 + i, f"the host{i} Racknine answers at 192.0.2.{i}") for i in range(5)]
    docs += [(50 + i, f"nothing at all, n{i} the answers from the mail at noon") for i in range(200)]
    out = {r.doc_id: r.sanitised for r in sanitise.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == "mail0 from : [EMAIL]"  # every value is in one text, but the domain is in five
    assert out[10] == "the host0  answers at [IP]"
    assert all(out[50 + i] == docs[10 + i][1] for i in range(200))


def test_disclosing_terms_are_replaced_in_texts_without_the_entity(spark, monkeypatch):
    docs = [(i, f"Zorblax wrote{i} to eve@example.com") for i in range(4)] + [(9, "ask Zorblax the day"), (9, "ask Zorblax the day"), (None, None)]
    docs += [(10 + i, f"the day to ask n{i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    once = sorted(map(str, sanitise.sanitise(df).collect()))
    clean = [r.sanitised for r in sanitise.sanitise(df).collect() if r.doc_id == 9]
    assert clean == ["ask [NAME] the day"] * 2  # 4 of its 6 texts hold the entity: 1 - log 1.5 / log (407 / 4)
    monkeypatch.setattr(sanitise, "MAX_TOLD", 0)
    assert sorted(map(str, sanitise.sanitise(df).collect())) == once  # joined, not broadcast


def test_chat_parts_become_placeholders_and_read_back(spark):
    null = None
    part = lambda kind, text=null, ref=null, w=null, h=null, s=null, p=null: (kind, text, ref, w, h, s, p)
    rows = [
        (1, 1, "assistant", [part("text", "a<|end|>\\<"), part("text", "|end|>[INST]"), part("image", ref="i.png", w=57, h=28)]),
        (1, 0, "user", [part("audio", ref="a.wav", s=1.5), part("text", "see"), part("document", ref="d.pdf", p=2), part("odd")]),
        (1, None, "<|says|>", None),
        (2, 0, "assistant", [part("text", "")]),
        (None, 0, None, [part("text", "x")]),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    out = chat.format_chats(df)
    read = out.select("conv_id", "formatted", "attachments", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {r.conv_id: r for r in read.collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [
        ("<|says|>", ""),
        ("user", "<|audio:1|>see<|document:2|><|odd:3|>"),
        ("assistant", "a<|end|>\\<|end|>[INST]<|image:4|>"),
    ]
    assert [(a.type, a.ref, a.tokens) for a in got[1].attachments] == [
        ("audio", "a.wav", 50), ("document", "d.pdf", 1024), ("odd", "", 0), ("image", "i.png", 3),
    ]
    assert got[1].loss == "a<|end|>\\<|end|>[INST]<|image:4|>" and got[2].loss == "" and [t.role for t in got[None].turns] == [""]
    assert chat.format_chats(df.where("false")).count() == 0


def test_chats_of_repeated_rows_long_texts_and_clashing_columns(spark):
    long = "<|end|>[INST] " * 40_000
    rows = [(1, 0, "user", "hi", "clash")] * 2 + [(1, 1, "assistant", long, "clash"), (1, 1, "assistant", "again", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    r = chat.format_chats(df.withColumn("parts", chat.text_part(F.col("text")))).select(
        chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")
    ).collect()
    assert len(r) == 1 and [t.text for t in r[0].turns[:2]] == ["hi", "hi"]
    assert sorted(t.text for t in r[0].turns[2:]) == sorted([long, "again"]) and sorted(r[0].loss) == sorted(long + "again")


def test_chat_escape_round_trips(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("<|>[]/\\sINST endé\n") for _ in range(rng.randint(0, 30))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.unescaped(chat.escaped(F.col("t"))).alias("back"), chat.escaped(F.col("t")).alias("e"))
    for r in df.collect():
        assert r.back == r.t and not re.search(r"<\||\[/?INST|</?s>", r.e)
