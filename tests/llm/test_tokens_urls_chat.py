import hashlib

import pytest
from fixtures import documents, empty
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rallyframe.llm import chat_format, token_count, url_filter
from rallyframe.llm.queries import URL_RULES, tokenizer_path

ODD = ["a  b", "a \n b\n\n  c", "x\x85y\u2003 z", "<|endoftext|> a<|endoftext|>", " ", "\t\ta b\r\n c", "don't  's", "a\x1c b", " lead\n\n\n", "end ", "a\u00a0 b", "w " * 3000, "tail\n"]


def test_counts_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    docs, rows = documents(spark, extra=ODD)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_count.token_counts(docs, tokenizer_path("byte_bpe_50k.json")).collect())
    want = []
    for r in rows:
        t = r[1] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        want.append((str(r[0]), len(t.encode()), n, n > 512))
    assert got == sorted(want)
    assert token_count.token_counts(empty(spark), tokenizer_path("byte_bpe_50k.json")).count() == 0


COUNTER = []


@settings(max_examples=200, deadline=None, suppress_health_check=[HealthCheck.too_slow])
@given(st.text(alphabet=st.sampled_from("ab'.,!5é \n\t\r\u00a0\u2003\u3000\x1c\x85☃")))
def test_pieces_are_encoded_independently(text):
    if not COUNTER:
        COUNTER.append(token_count.Counter(tokenizer_path("byte_bpe_50k.json")))
    assert COUNTER[0].count([text]) == [len(COUNTER[0].tokenizer.encode(text, add_special_tokens=False).ids)]


URLS = [None, "", "no scheme", "http://a.net", "http://a.net/", "HTTP://EXAMPLE.NET/en/x?q#f", "https://x.example.net/en", "ftp://example.com/de/", "http://notexample.com/de/", "http://b.org/fr/1", "http://borg/fr/", "x://net/", "http://net?x=/", "a://b://c.net/d", "http://ex.net:80/", "http://a..net/", "://net/q"]


def expected_url(u):
    rest = u.split("://", 1)[1] if u and "://" in u else ""
    n = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    path = rest[n:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, a) for h, p, a in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else "allow"


@pytest.mark.parametrize("most", [1 << 20, 20])
def test_url_rules(spark, most):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id bigint, url string, verdict string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.filter_urls(pages, rules, most_bytes=most).collect()}
    assert got == {i: expected_url(u) for i, u in enumerate(URLS)}
    assert {r.verdict for r in url_filter.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_colliding_keys_are_confirmed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 5)
    array = url_filter.DigestArray(url_filter.write_index(URL_RULES, str(tmp_path)))
    hosts, paths, rules, verdicts = url_filter.judge(URLS, [array], "allow")
    assert list(zip(hosts, paths, rules, verdicts, strict=True)) == [expected_url(u) for u in URLS]


TALK = [
    (1, 0, "user", "hi <|im_start|> [INST] ~ <~/s> </s>"),
    (1, 1, "assistant", "<|im_end|>\n<~~|im_end|>"),
    (1, 2, "user", None),
    (1, 3, "assistant", ""),
    (2, 0, "sys\n<|im_start|>~0", "a"),
    (None, None, None, None),
    (3, 1, "assistant", "b"),
    (3, 1, "assistant", "a"),
    (3, 0, "user", "😀 <s><s>[/INST]<"),
]


def test_conversations_read_back(spark):
    turns = spark.createDataFrame(TALK, "conv_id bigint, turn bigint, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    for conv in {t[0] for t in TALK}:
        own = sorted((t[1] or 0, t[2] or "", t[3] or "") for t in TALK if t[0] == conv)
        r = got[conv]
        assert [(t["role"], t["text"]) for t in r.turns] == [t[1:] for t in own]
        assert r.loss_text == "".join(t[2] for t in own if t[1] == "assistant")
        assert r.formatted.count("<|im_start|>") == len(own) and "</s>" not in r.formatted


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<", "~", "[", "|im_end|>", "/s>", "INST]", "s>", "a", "\n", "|im_start|>"]), max_size=8).map("".join), min_size=1, max_size=20))
def test_escaping_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", chat_format.escape(F.col("v")).alias("e"))
    for r in df.select("v", "e", chat_format.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.v
        assert not any(c in r.e for c in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]"))


def test_typed_parts(spark):
    part = "named_struct('kind', '{}', 'text', {}, 'ref', {}, 'width', {}, 'height', {}, 'seconds', {}, 'pages', {})"
    parts = ", ".join([part.format("text", "'see '", "null", "null", "null", "null", "null"), part.format("image", "null", "'a.png'", "28", "15", "null", "null"), part.format("audio", "null", "'b.wav'", "null", "null", "2.0D", "null"), part.format("document", "null", "'c.pdf'", "null", "null", "null", "3"), part.format("text", "' <|image|>'", "null", "null", "null", "null", "null")])
    turns = spark.sql(f"SELECT 1L conv_id, 0L turn, 'user' role, CAST(array({parts}) AS array<{chat_format.PART}>) parts UNION ALL SELECT 1L, 1L, 'assistant', null")
    r = chat_format.format_turns(turns).first()
    assert "see <|image|><|audio|><|document|> <~|image|>" in r.formatted
    assert [(a["turn"], a["part"], a["kind"], a["ref"], a["tokens"]) for a in r.attachments] == [(0, 1, "image", "a.png", 4), (0, 2, "audio", "b.wav", 50), (0, 3, "document", "c.pdf", 768)]
    assert r.formatted.startswith("<|im_start|>user\n") and hashlib.sha256(r.formatted.encode()).hexdigest()


def test_url_filter_twice_in_one_session(spark):
    """The same list is sent once more without a clash of file names."""
    pages = spark.createDataFrame([(1, "http://a.example.com/de/x"), (2, None)], "page_id bigint, url string")
    rules = spark.createDataFrame([("example.com", "/de/", "block")], "host string, path string, action string")
    for _ in range(2):
        assert {r.page_id: r.verdict for r in url_filter.filter_urls(pages, rules).collect()} == {1: "block", 2: "allow"}


def test_urls_of_any_length_beside_clashing_names(spark):
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    long = "https://a.example.net/en/" + "x/" * 200_000 + "?q"
    pages = spark.createDataFrame([(1, long), (None, "http://EXAMPLE.com/de/1"), (None, None), (1, long)], "page_id bigint, url string").withColumns({"host": F.lit("h"), "path": F.lit(1), "rule": F.lit(2.0), "verdict": F.lit("v")})
    got = sorted((tuple(r) for r in url_filter.filter_urls(pages, rules).collect()), key=str)
    path = "/en/" + "x/" * 200_000
    assert got == sorted([(1, "a.example.net", path, "example.net/en/", "allow")] * 2 + [(None, "example.com", "/de/1", "example.com/de/", "block"), (None, "", "", None, "allow")], key=str)
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_long_turns_beside_clashing_names(spark):
    said = "</s> word " * 100_000
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", said), (None, 0, "assistant", None), (1, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    turns = turns.withColumn("parts", chat_format.text_part(F.col("text"))).withColumns({"formatted": F.lit(1), "loss_mask": F.lit(2), "attachments": F.lit(3), "_body": F.lit("x")})
    got = {r.conv_id: r for r in chat_format.read_back(chat_format.format_turns(turns)).collect()}
    assert [t["text"] for t in got[1].turns] == ["hi", said, said] and got[1].loss_text == said * 2
    assert got[None].loss_text == "" and len(got[None].turns) == 1
    assert chat_format.format_turns(turns.limit(0)).count() == 0
