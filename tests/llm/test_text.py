"""Personal data, byte pairs and quality rules against plain versions."""

import random
import re
import struct
import tracemalloc

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pyspark.sql import functions as F

from tidemark.llm import bpe, pii, quality_rules

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_pii(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d[::-1])) % 10 == 0
            if {"ip": kind == "ip" and max(map(int, re.split(r"\.", m[0]))) <= 255 if kind == "ip" else True, "card": 12 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15, "email": True}[kind]:
                out[kind].append(m.span())
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.@ab-_+ ()%12", max_size=70))
def test_base_identifiers(text):
    assert pii.find(text) == plain_pii(text)


@pytest.mark.parametrize(
    ("text", "kind", "piece"),
    [
        ("mail jоhn.doe [at] example [dot] com now", "email", "jоhn.doe [at] example [dot] com"),
        ("jane at mail dot example dot com", "email", "jane at mail dot example dot com"),
        ("call plus one two one two five five five oh one two three ok", "phone", "plus one two one two five five five oh one two three"),
        ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
        ("４２８２０２６６７８１９５９１４", "card", "４２８２０２６６７８１９５９１４"),
        ("j​ohn@example．com", "email", "j​ohn@example．com"),
        ("a é 😀 b [at] c [dot] org", "email", "b [at] c [dot] org"),
    ],
)
def test_disguises_map_back(text, kind, piece):
    base, every = pii.spans_of(text)
    assert base[kind] == [] and [text[a:b] for a, b in every[kind]] == [piece]


@pytest.mark.parametrize("text", ["I am at home dot", "one two three", "at the dot com boom", "Привет мир", "un dos tres", "the one at the two dots", "", "seven dot eight"])
def test_ordinary_text_is_left_alone(text):
    assert pii.written(pii.spans_of(text)[1]) == ""


DOT_ONLY = [
    ("email", "jane.doe@example [dot] com"),
    ("email", "jane@mail dot org"),
    ("ip", "10[.]0[.]0[.]1"),
    ("ip", "192 dot 168 dot 1 dot 20"),
    ("ip", "192 punkt 168 punkt 1 punkt 20"),
    ("ip", "one dot 168 dot two dot 20"),
]


@pytest.mark.parametrize("beside", ["", " and mail bob [at] site [dot] com", " and Привет", " and 4 one two three four"])
@pytest.mark.parametrize(("kind", "piece"), DOT_ONLY)
def test_dots_alone_are_a_disguise(kind, piece, beside):
    text = f"write to {piece}, please{beside}"
    base, every = pii.spans_of(text)
    assert base[kind] == [] and piece in [text[a:b] for a, b in every[kind]]


def test_written_dots_without_identifiers():
    assert pii.written(pii.spans_of("the dot product, 3 point 5, one dot 2 dot 3, 300 dot 1 dot 1 dot 1, v1[.]2")[1]) == ""
    assert len(pii.spans_of(("1 dot " * 200_000 + "x") + "1" * 300_000 + "x")[1]["ip"]) == 50_000


def test_base_spans_stay():
    base, every = pii.spans_of("x@y.zz and jоhn@z.org and 1.2.3.4")
    assert pii.written(base) == "email:0:6,email:13:18,ip:23:30" or set(base["email"]) <= set(every["email"])


def test_redaction(docs_of):
    docs = docs_of(["a x@y.zz b", None, "", "card 4282026678195914."])
    got = [r["text"] for r in pii.stage(None, docs, "").orderBy("doc_id").collect()]
    assert got == ["a <EMAIL> b", None, "", "card <CARD>."]
    assert pii.stage(None, docs, "").columns == docs.columns


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "+" * 100_000, "a" * 300_000 + "@", "1." * 150_000, "@" * 100_000):
        pii.spans_of(text)


def test_pii_rows(docs_of, spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op3_pii(spark, sf_dir).collect()}
    for r in docs.collect():
        base = plain_pii(r["text"])
        assert [got[r["doc_id"]][f"n_{k}"] for k in pii.KINDS] == [len(base[k]) for k in pii.KINDS]
    assert pii.detect(docs_of([None, ""])).where("spans = ''").count() == 2


@pytest.fixture(scope="module")
def both():
    return Tokenizer.from_file(bpe.vocabulary()), bpe.load(bpe.vocabulary())


def agree(both, text):
    theirs, ours = both
    want, got = theirs.encode(text, add_special_tokens=False), ours.encode(text)
    assert list(struct.unpack(f"<{len(got) // 4}I", got)) == want.ids
    for size in (1, 7, len(got) + 1):
        state = ours.written()
        assert "".join(state.push(got[i : i + size]) for i in range(0, len(got), size)) == theirs.decode(want.ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabcdeeinrstth'sld 1 éßİΣſ\n\t,.!-日本😀́\x1c\x85\xa0"), max_size=90))
def test_encoding_is_the_library_s(both, text):
    agree(both, text)


@pytest.mark.parametrize("text", ["", "a" * 5000, "ab" * 4000, "the" * 3000, "<|endoftext|>", "x<|startoftext|> y<|endoftext|", "'LL they're", "!" * 700, "é" * 900, "\x00", "#$%" * 500])
def test_long_words_stream(both, text):
    agree(both, text)


def test_random_long_words(both):
    r = random.Random(3)
    for _ in range(60):
        agree(both, "".join(r.choices("aaaebhtnrs", k=r.randint(100, 1500))))


def test_state_stays_small(both):
    """Over 400,000 bytes of one word, no more than a few windows are held at once, and tokens come out on the way."""
    ours, taken, given_ = both[1], 0, 0
    ours.most_held = 0

    def blocks():
        nonlocal given_
        for _ in range(20_000):
            given_ += 1
            yield b"internationalthequick"

    for taken, _ in enumerate(ours.stream(blocks()), 1):
        if taken == 1000:
            assert given_ < 2000
    assert taken > 20_000 and 0 < ours.most_held <= 6 * ours.lookahead


def test_a_long_text_is_held_in_pieces(both):
    ours, theirs = both[1], both[0]
    part = "the quick brown fox jumps over Σ the lazy dog\n" * 3000
    assert b"".join(ours.encoded(part)) == struct.pack(f"<{len(i := theirs.encode(part, add_special_tokens=False).ids)}I", *i)
    text, state, n = part * 60, ours.written(), 0
    tracemalloc.start()
    for raw in ours.encoded(text):
        n += len(raw) // 4
        state.push(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 1_500_000 and peak < 8 << 20


def test_decoding_in_any_cuts(both):
    ours = both[1]
    text = "naïve 日本 😀 the café"
    ids = list(struct.unpack(f"<{len(ours.encode(text)) // 4}I", ours.encode(text)))
    for size in (1, 2, 5, 100):
        d = ours.decoder()
        assert "".join(d.push(ids[i : i + size]) for i in range(0, len(ids), size)) + d.close() == text + " "


def test_encoded_rows(docs_of):
    docs = docs_of([None, "", "the cat", "x" * 100_000])
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs).collect()}
    assert got[0] == got[1] == [] and len(got[2]) == 2 and len(got[3]) > 100
    assert bpe.encode(docs.limit(0)).count() == 0


def plain_rules(text):
    words = re.findall(r"[^ \t-\r]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^ \t-\r]", x)]
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {i + j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_rules_by_brute_force(docs_of):
    r = random.Random(1)
    texts = [None, "", " \t\n", "a" * 500, "é # 😀 *", *(" ".join(r.choices("abc", k=r.randint(0, 120))) + r.choice(["", "\nx\nx\n \n", "\x0bq"]) for _ in range(60))]
    m = quality_rules.measure(docs_of(texts), ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"])
    for row in m.collect():
        assert (row["n_words"], row["word_chars"], row["n_symbols"], row["n_dup_lines"], row["n_repeat_words"]) == plain_rules(texts[row["doc_id"]])


def test_order_changes_cost_and_not_verdicts(docs_of):
    texts = ["word " * 5, "a b c d e f g h " * 20, " ".join(f"w{i}#" for i in range(60)), " ".join(f"word{i}" for i in range(60)), None, "same line here\n" * 30]
    docs = docs_of(texts)
    measured = quality_rules.measure(docs, [m for r in quality_rules.RULES for m in r.needs])
    for rules in (quality_rules.RULES, quality_rules.RULES[::-1]):
        got = quality_rules.cascade(measured, rules).select("doc_id", "failed_rule").collect()
        assert [r["failed_rule"] is None for r in sorted(got)] == [False, False, False, True, False, False]


def test_measures_are_taken_where_needed(docs_of):
    few, words, repeats = quality_rules.RULES[0], quality_rules.RULES[4], quality_rules.RULES[1]
    got = sorted(quality_rules.cascade(docs_of(["a b", "word " * 30, None]), [few, words]).select("doc_id", "failed_rule", "word_chars").collect())
    assert [(r["failed_rule"], r["word_chars"]) for r in got] == [("few_words", None), (None, 120), ("few_words", None)]
    assert repeats.needs == ("n_words", "n_repeat_words")


def test_dear_measures_are_not_taken_of_rejected_rows(docs_of, monkeypatch):
    """A measure that fails on short texts: only rows that got past `few_words` may be asked for it."""
    monkeypatch.setitem(quality_rules.MEASURES, "boom", (("n_words",), lambda: F.when(F.col("n_words") < 20, F.raise_error(F.lit("taken"))).otherwise(F.lit(1))))
    dear = quality_rules.Rule("dear", ("boom",), "boom < 1")
    docs = docs_of(["a b", None, "word " * 30])
    got = quality_rules.cascade(docs, [quality_rules.RULES[0], dear]).select("doc_id", "failed_rule").collect()
    assert [r["failed_rule"] for r in sorted(got)] == ["few_words", "few_words", None]
    with pytest.raises(Exception, match="taken"):
        quality_rules.cascade(docs, [dear, quality_rules.RULES[0]]).collect()


def test_order_by_rejections_per_second(docs_of):
    docs = docs_of(["a b c"] * 30)
    assert quality_rules.order(docs)[0].name in ("few_words", "word_length")
    assert len(quality_rules.order(docs.limit(0))) == len(quality_rules.RULES)


def test_more_than_a_thousand_sources_are_mixed(spark):
    from tidemark.llm import mixing

    docs = spark.range(41_100).selectExpr("id AS doc_id", "IF(id < 40000, 'big', concat('host', id)) AS source", "'t' AS text")
    got = mixing.mix(docs).where("source <> 'big' OR _block = 0").select("source", "_slot").distinct().collect()
    assert mixing.mix(docs).count() == 41_100
    assert len(got) == 1_101 and len({r["_slot"] for r in got}) == 1_101 and max(r["_slot"] for r in got) < 1_200
