"""Decontamination, tokens, language, pages, chat, scores."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_format, decontaminate, html_text, language, lm_scoring, token_blocks
from tests.llm.helpers import documents, hits, odd_rows, words

tokenizers = pytest.importorskip("public_tokenizers")
BPE = tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("bound", [1_000_000, 8])
def test_windows_against_every_position(spark, bound):
    r = random.Random(1)
    vocabulary = ["a", "B", "c3", "dé", "x", "y"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 1, 3, 4, 5, 9])))) for i in range(12)] + [(50, None), (51, "...")]
    rows = [(i, ", ".join(r.choice(vocabulary) for _ in range(r.randint(0, 40)))) for i in range(80)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_windows(documents(spark, rows), benchmark, n=4, max_windows=bound)
    got = {x.doc_id: x for x in found.select("doc_id", "found", decontaminate.n_hit().alias("n_hit"), decontaminate.contaminated().alias("bad")).collect()}
    for i, text in rows:
        n, hit, said = hits(text, items, 4)
        assert (got[i].found.n_words, got[i].n_hit, set(got[i].found["items"])) == (n, hit, said)
        assert got[i].bad == (hit > 0 and 20 * hit >= n)


def test_removal(spark):
    benchmark = spark.createDataFrame([(1, "Alpha beta gamma")], "item_id long, text string")
    df = documents(spark, [(1, "x é ALPHA-beta gamma. y"), (2, "clean"), (3, None), (4, " ".join(["z"] * 70) + " alpha beta gamma")])
    found = decontaminate.find_windows(df, benchmark, n=3)
    assert [x.doc_id for x in decontaminate.remove(found).orderBy("doc_id").collect()] == [2, 3, 4]
    cut = {x.doc_id: x.text for x in decontaminate.remove(found, how="spans").collect()}
    assert cut[1] == "x é . y" and cut[2] == "clean" and cut[3] is None
    assert decontaminate.find_windows(documents(spark, odd_rows()).withColumnRenamed("lang", "found"), benchmark).count() == len(odd_rows())
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_windows(df, empty).where("size(found.items) > 0").count() == 0


@pytest.mark.parametrize("bound", [1_000_000, 4])
def test_items_without_a_name_or_number(spark, bound):
    df = documents(spark, [(1, "x alpha beta gamma y"), (2, "delta epsilon zeta"), (3, "clean words here"), (4, "one two three alpha beta gamma")])
    for kind, names in (("long", (7, 8)), ("string", ("7", "q-8"))):
        items = [(None, "alpha beta gamma"), (names[0], "delta epsilon zeta"), (names[1], "one two three"), (None, None)]
        found = decontaminate.find_windows(df, spark.createDataFrame(items, f"item_id {kind}, text string"), n=3, max_windows=bound)
        got = {x.doc_id: (x.n_hit, x.bad, x.names) for x in found.select("doc_id", decontaminate.n_hit().alias("n_hit"), decontaminate.contaminated().alias("bad"), F.col("found.items").alias("names")).collect()}
        assert got == {1: (3, True, []), 2: (3, True, [names[0]]), 3: (0, False, []), 4: (6, True, [names[1]])}
        assert [x.doc_id for x in decontaminate.remove(found).collect()] == [3]


@pytest.mark.parametrize(("kind", "block"), [("byte", 64), ("bit", 64), ("byte", 1 << 16)])
def test_token_blocks_round_trip(spark, kind, block):
    rows = [(i * 7 % 101, "Some text, number %d! \n\nAnd  so on " % i * (i % 9)) for i in range(101)] + odd_rows()[:7]
    path = token_blocks.write(documents(spark, rows), BPE, kind=kind, block_ids=block)
    got = sorted(((x.doc_id if x.doc_id is not None else -1, x.start, x.n_tokens, x.ids_crc32) for x in token_blocks.read(spark, path).collect()), key=lambda x: x[1])
    plain = token_blocks.Encoder(BPE, None)
    start, want = 0, Counter()
    for doc_id, *_ in got:
        assert doc_id is not None
    encoded = {}
    for doc_id, text in rows:
        ids = np.append(np.frombuffer(plain.whole([text or ""])[0], "<u2"), 0).astype("<u4")
        want[(doc_id if doc_id is not None else -1, len(ids), zlib.crc32(ids.tobytes()))] += 1
        encoded[doc_id] = ids
    assert Counter((d, n, c) for d, _, n, c in got) == want
    assert [d for d, *_ in got] == sorted(d for d, *_ in got)
    for _, at, n, _ in got:
        assert at == start
        start += n


def test_units_encode_as_whole_texts():
    r = random.Random(1)
    alphabet = " \n\t\r  　\x1c\x85ab'sB9!é日🙂́.,"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 40))) for _ in range(5000)] + ["it's <|endoftext|> done", "", " ", "Ünï çödé, x.\nNext"]
    cut, whole = (token_blocks.Encoder(BPE, unit).encode(pa.array(texts)) for unit in (token_blocks.UNIT, None))
    assert [bytes(x) for x in cut] == [bytes(x) for x in whole]


def test_added_tokens_are_one_id():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    texts = ["it's <|endoftext|> done", "a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|>\n\n<|endoftext|> y", "<|endoftext| >", "no token", ""]
    got = [np.frombuffer(x, "<u2").tolist() for x in token_blocks.Encoder(BPE, token_blocks.UNIT).encode(pa.array(texts))]
    assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts] and got[2] == [50256]


def test_planes():
    ids = np.arange(1000, dtype=np.uint32) * 37 % 50257
    for kind in ("byte", "bit"):
        for width in (2, 4):
            assert (token_blocks.from_planes(token_blocks.to_planes(ids, width, kind), 1000, width, kind) == ids).all()


def test_token_blocks_odd_rows(spark):
    path = token_blocks.write(documents(spark, odd_rows()), BPE, block_ids=1000)
    assert token_blocks.read(spark, path).count() == len(odd_rows())
    assert token_blocks.read(spark, token_blocks.write(documents(spark, []), BPE)).count() == 0


def labelled(n=240):
    r = random.Random(9)
    parts = {"aa": ["the", "ing", "th", "er"], "bb": ["que", "ción", "el", "ñ"], "cc": ["sch", "ung", "ü", "ei"]}
    return [(i, " ".join("".join(r.choice(parts[lang]) for _ in range(3)) for _ in range(r.randint(3, 60))), lang) for i, lang in ((i, r.choice(sorted(parts))) for i in range(n))]


def test_language_held_out(spark):
    rows = labelled()
    model = language.fit(documents(spark, rows[:160]))
    got = language.predict(documents(spark, rows[160:]), model).collect()
    assert sum(x.guess.lang == x.lang for x in got) >= 0.97 * len(got) and all(0 <= x.guess.score <= 1 for x in got)
    odd = {(x.doc_id, x.text): x.guess for x in language.predict(documents(spark, odd_rows()), model).collect()}
    assert odd[1, None].lang == "und" and odd[1, None].rejected and odd[2, ""].score == 0 and odd[5, "a b c d e f g"].lang in ("aa", "bb", "cc")
    assert language.predict(documents(spark, []), model).count() == 0
    with pytest.raises(ValueError):
        language.fit(documents(spark, odd_rows()))


@pytest.mark.parametrize("languages", ["abc", "ab", "a"])
def test_unlearned_texts_are_rejected(spark, languages):
    rows = [x for x in labelled(900) if x[2][0] in languages]
    model = language.fit(documents(spark, [x for x in rows if x[0] % 3]))
    clean = [t for i, t, _ in rows if i % 3 == 0]
    by = {lang: [t for i, t, x in rows if i % 3 == 0 and x == lang] for lang in sorted({x[2] for x in rows})}
    mixed = [f"{a} {b}" for x in by for y in by if x != y for a, b in zip(by[x], by[y])]
    r = random.Random(2)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(20)) for _ in range(20)]
    scripts = ["Это текст на языке которого никто не учил", "αυτό είναι ένα κείμενο σε άγνωστη γλώσσα", "これは学習されていない言語で書かれた文章です"]
    said = [*clean, *mixed, *noise, *scripts]
    got = {x.doc_id: x.guess.rejected for x in language.predict(documents(spark, list(enumerate(said))), model).collect()}
    kept = [not got[i] for i in range(len(said))]
    n, m = len(clean), len(clean) + len(mixed)
    assert sum(kept[:n]) >= 0.98 * n and sum(kept[n:m]) >= 0.98 * (m - n)
    assert not any(kept[m:])


def test_language_ignores_batches(spark):
    model = language.fit(documents(spark, labelled()))
    texts = [t for _, t, _ in labelled(40)] + ["", "é", "ab"]
    together = model.scores(*language.as_bytes(pa.array(texts)))
    for i, t in enumerate(texts):
        assert together[i] == pytest.approx(model.scores(*language.as_bytes(pa.array([t])))[0])


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy now.</div><article><h1>T &amp; x</h1><p>One <b>two</b><br>three</p>
<p>short</p><ul><li>item<li>next</ul><div class="comments"><p>I disagree with everything that was said here at length</p></div></article>
<aside>side</aside><form>Subscribe <input></form><footer>&copy; 2020</footer></body></html>"""


def test_page_text():
    assert html_text.main_text(PAGE) == "T & x\nOne two three\nshort\nitem\nnext"
    assert html_text.main_text(PAGE[: PAGE.index("<aside")]) == html_text.main_text(PAGE)
    assert html_text.main_text("<p>a &lt; b<p>c < d</p>") == "a < b\nc < d"
    assert html_text.main_text("<div><a href=x>one</a></div><div><a href=y>two</a></div><p>" + "word " * 40) == ("word " * 40).strip()
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<script>x") == ""
    assert html_text.main_text("plain words without any tag that go on for a good while") != ""


ARTICLE = "<article><h1>Title here</h1><p>" + "word " * 40 + "</p></article>"


@pytest.mark.parametrize("before", [
    "<script>for(var i=0;i<n;i++){x()}</script>", "<script>if(a<b)</script>", "<SCRIPT>x='</p><b'</SCRIPT >", "<style>a<b{}</style>", "<textarea>a<b</textarea>", "<title>a<b</title>",
    "<button>Click", "<button>a</button><button>b", "<select><option>a<option>b", "<svg><path d='M'/>", "<svg><title>x<y</title></svg>", "<object>", "<noscript>on",
    "<noscript><p>please turn on scripts</p></noscript>", "<template><article><p>" + "no " * 40 + "</p></article></template>",
])
def test_raw_and_invisible_elements_lose_no_text(before):
    want = "Title here\n" + ("word " * 40).strip()
    assert html_text.main_text("<html><body>" + before + ARTICLE) == want
    assert html_text.main_text("<html><body><div>" + before + "</div>" + ARTICLE) == want
    if not before.startswith(("<button>Click", "<select", "<object", "<noscript>on", "<svg><path", "<button>a")):
        assert html_text.main_text("<html><body><article><h1>Title here</h1>" + before + "<p>" + "word " * 40) == want


def test_pages_frame(spark):
    df = spark.createDataFrame([(1, PAGE, "old"), (None, None, None)], "page_id long, html string, text string")
    got = {x.page_id: x.text for x in html_text.extract(df).collect()}
    assert got[None] == "" and got[1].startswith("T & x")
    assert html_text.extract(df.limit(0)).count() == 0


def test_chat_round_trip(spark):
    r = random.Random(3)
    control = ["### Assistant: ", "</turn>", "\\", "\\h", "#", ": ", "\n", "a", "é", "</", "~"]
    rows = [(c, t, r.choice(["user", "assistant", "system", "odd: role", "Assistant", None]), "".join(r.choice(control) for _ in range(r.randint(0, 9)))) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "assistant", None), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    got = {x.conv_id: x for x in chat_format.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in {x[0] for x in rows}:
        turns = sorted(((t, role, text) for c, t, role, text in rows if c == conv), key=lambda x: (x[0], x[1] is not None, x[1] or "", x[2] is not None, x[2] or ""))
        said = chat_format.parse(got[conv].formatted)
        assert said == [(role or "", text or "") for _, role, text in turns]
        assert [chat_format.unescape(got[conv].formatted[a:b]) for a, b in got[conv].loss_spans] == [text or "" for _, role, text in turns if role == "assistant"]
        assert got[conv].rewrites == 0 and got[conv].turn_spans[-1][1] == len(got[conv].formatted)
    assert chat_format.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_rewriting_template_is_found():
    def rewriting(turns):
        return "".join(f"<{r}>{t if i == len(turns) - 1 else t[:2]}</s>" for i, (r, t) in enumerate(turns))

    _, _, _, rewrites = chat_format.locate(rewriting, [("user", "hello there"), ("assistant", "fine"), ("user", "x")])
    assert rewrites == 2
    assert chat_format.locate(chat_format.turn_template, [("user", "a"), ("assistant", "b")])[3] == 0


PIECES = tokenizers.path("piece_bpe_32k.model")


def test_lattice_sums_all_segmentations():
    pieces = lm_scoring.pieces_of(PIECES)
    logp = pieces.initial

    def total(word):
        if not word:
            return 1.0
        return sum(math.exp(logp[pieces.index[word[:i]]]) * total(word[i:]) for i in range(1, len(word) + 1) if word[:i] in pieces.index)

    some = [b" the", b" thndinged", " été".encode(), b" x", b" zzqj"]
    got, expected = lm_scoring.score_words(pieces, logp, some, np.ones(len(some)))
    assert got == pytest.approx([math.log(total(w)) for w in some])
    lengths = np.array([len(p) for p in pieces.pieces])
    assert (expected * lengths).sum() == pytest.approx(sum(map(len, some)))
    long = b" " + b"abcdefghij" * 40
    alone, counts = lm_scoring.score_words(pieces, logp, [long], np.ones(1))
    assert math.isfinite(alone[0]) and (counts * lengths).sum() == pytest.approx(len(long))
    assert lm_scoring.lattice(pieces, logp, b" thndinged")[0][-1] == pytest.approx(got[1])


def check_base_scores(rows, got):
    """Every row against counts of all tokens."""
    assert len(got) == len(rows)
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    counts = Counter(w for i, t in rows if i is not None and not held[i] for w in [*words(t), "END "])
    total, distinct = sum(counts.values()), len(counts)
    for x in got:
        tokens = [*words(dict(rows)[x.doc_id]), "END "]
        assert (x.held_out, x.n_tokens, x.n_known, x.train_tokens) == (held[x.doc_id], len(tokens), sum(counts[w] > 0 for w in tokens), total)
        assert x.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in tokens))
        assert x.score < 0


def test_scores_against_counts(spark):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["the", "Of", "ing", "thndinged", "é", f"rare{i}"]) for _ in range(r.randint(0, 30)))) for i in range(120)] + [(500, None), (None, "the of")]
    check_base_scores(rows, lm_scoring.score(documents(spark, rows), PIECES, block_rows=16).collect())
    assert lm_scoring.score(documents(spark, odd_rows()), PIECES).count() == len(odd_rows())
    assert lm_scoring.score(documents(spark, []), PIECES).count() == 0


@pytest.mark.parametrize("salt", [128, 1])
def test_scores_of_files_in_any_order(spark, tmp_path, monkeypatch, salt):
    monkeypatch.setattr(lm_scoring, "SALT_PARTS", salt)
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 2000)
    monkeypatch.setattr(lm_scoring, "SHORT", 64)
    r = random.Random(7)
    rows, files = [], [7, 90, 1, 40, 200, 3, 33, 60, 11, 155]  # Spark packs files into tasks by size, so numbers come in no order
    for number, n in enumerate(files):
        part = [(1000 * number + i, " ".join(r.choice(["the", f"only{number}", f"rare{number}x{i}", "", " "]) for _ in range(r.choice([0, 5, 30, 900])))) for i in range(n)]
        documents(spark, part, 1).write.parquet(str(tmp_path / f"d/part={number}"))
        rows += part
    given = spark.read.parquet(str(tmp_path / "d"))
    assert given.rdd.getNumPartitions() > 1
    check_base_scores(rows, lm_scoring.score(given, PIECES, block_rows=16, rounds=1).collect())


def test_words_of_a_block_in_any_order():
    batch = pa.record_batch([pa.array(["a b", "c", "b d"]), pa.array([5, 2, 5]), pa.array([True, True, False])], names=["text", "block", "train"])
    found = [r for b in lm_scoring.block_words(iter([batch])) for r in b.to_pylist()]
    assert sorted((r["block"], r["word"], r["count"]) for r in found) == [(2, b"c", 1), (5, b"a", 1), (5, b"b", 1), (5, b"d", 0)]
