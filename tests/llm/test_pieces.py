"""SentencePiece encoding against the library itself."""

import random

import brute
import pytest
import sentencepiece

from codequarry.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "\n", "a", "hello world", " leading", "trailing  ", "a  b   c", "tab\tand\nline\r\n", "▁▁ meta ▁", "naïve café – déjà vu", "日本語のテキスト", "emoji 🎉👩‍👩‍👧 end",
    "\u0000\u0001 control", "x" * 3000, "ab" * 2000, "0123456789" * 50, "!?.,;:" * 40, "<s></s><unk><0x41>", "e\u0301 combining", "ﬁ ligature ① Ⅳ", "\u3000wide\u00a0space\u200b", "\ufeffbom", "العربية русский ελληνικά हिन्दी", " ▁ ▁", "don't I'll we've",
]


def texts():
    pick = random.Random(4)
    out = list(ODD)
    letters = "abcdefghijklmnopqrstuvwxyz" * 4 + "ABCÄÖÜéèñßçøłđž0123456789 ,.-_/'\"()[]{}<>@#\n\t▁日本🎉е" + " " * 20
    for n in (1, 2, 3, 5, 8, 13, 40, 200, 1000):
        out += ["".join(pick.choice(letters) for _ in range(n)) for _ in range(25)]
    return out


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_ids_and_texts_are_the_librarys(library):
    table = pieces.PrefixTable(MODEL)
    for t in texts():
        want = library.encode(t)
        (got,) = table.both([t])
        assert got == (",".join(map(str, want)), library.decode(want)), t
        assert table.decode(want) == library.decode(want), t


def test_merges_by_definition_agree_with_the_table(library):
    table = pieces.PrefixTable(MODEL)
    for t in ("hello world", "unbelievable", "internationalization of things", "aaaaaaaaaaaaa", "mississippi"):
        assert library.encode(t) == [table.ids[p] for p in pieces._merged(" " + t, table.score)]


def test_any_ids_decode_as_the_library_does(library):
    pick, table = random.Random(8), pieces.PrefixTable(MODEL)
    first, last = table.byte_range
    for n in (1, 2, 5, 30):
        for _ in range(40):
            ids = [pick.choice([pick.randrange(library.get_piece_size()), pick.randint(first, last)]) for _ in range(n)]
            if library.unk_id() not in ids:
                assert table.decode(ids) == library.decode(ids), ids


def test_query_digests_and_round_trip(spark, library):
    rows = [(i, t, "x", 7) for i, t in enumerate(texts())] + [(None, None, None, None), (3, "twice", "y", 1), (3, "twice", "y", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted(map(tuple, pieces.digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i, len(ids), brute.sha(",".join(map(str, ids))), brute.sha(library.decode(ids))))
    assert got == sorted(want, key=str)
    back = pieces.decode(pieces.encode(docs), to="again").where("doc_id IS NOT NULL").select("text", "ids", "again").collect()
    assert all(r["again"] == library.decode(r["ids"]) for r in back)
    assert pieces.digests(docs.limit(0)).count() == 0
