import random

from hypothesis import given, settings
from hypothesis import strategies as st

from talelake.llm.packing import pack, pack_documents, pack_texts

PIECE = st.tuples(st.integers(1, 10), st.sampled_from(["a", "b", "c", None]), st.sampled_from("xyz12345"))


def brute(pieces, capacity):
    bins, found = [], {}
    for k in sorted(range(len(pieces)), key=lambda k: -pieces[k][0]):
        size, source, cluster = pieces[k]
        fit = [b for b in bins if b[0] >= size and source not in b[1] and cluster not in b[2]]
        if fit:
            room = min(b[0] for b in fit)
        else:
            bins.append([capacity, set(), set(), []])
            fit, room = bins[-1:], capacity
        found[k] = room
        # which of equally tight bins is taken is open, so only the residual is compared
        b = next(b for b in fit if b[0] == room)
        b[0] -= size
        b[1].add(source)
        b[2].add(cluster)
    return found


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECE, max_size=40))
def test_rules(pieces):
    found = pack(pieces, 10)
    bins = {}
    for (size, source, cluster), (number, at) in zip(pieces, found, strict=True):
        bins.setdefault(number, []).append((at, size, source, cluster))
    for content in bins.values():
        end = 0
        for at, size, _, _ in sorted(content, key=lambda c: c[0]):
            assert at == end
            end += size
        assert end <= 10 and len({s for _, _, s, _ in content}) == len({c for _, _, _, c in content}) == len(content)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10), st.just("a"), st.just("x")), max_size=12), st.lists(st.integers(1, 10), max_size=30))
def test_tightest(conflicting, sizes):
    assert len({n for n, _ in pack(conflicting, 10)}) == len(conflicting)
    free = [(s, f"s{k}", f"c{k}") for k, s in enumerate(sizes)]
    assert {k: 10 - at for k, (_, at) in enumerate(pack(free, 10))} == brute(free, 10)


def test_documents(spark):
    r = random.Random(0)
    rows = [(k, " ".join("w" * r.randrange(1, 9) for _ in range(r.choice([1, 5, 300, 5000]))), r.choice(["hot", "hot", "b", None]), 7) for k in range(300)]
    rows += [(900, None, "b", 1), (901, "", "b", 1), (902, "same text", "c", 1), (903, "same \n text", "d", 1), (904, "twice", "e", 1), (904, "twice", "e", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, piece int")
    packed = pack_documents(docs)
    found = packed.collect()
    words = {}
    for d, t, _, _ in rows:
        words[d] = words.get(d, 0) + max(1, len((t or "").split()))
    got, bins = {}, {}
    source = {d: s for d, _, s, _ in rows}
    for x in found:
        got[x.doc_id] = got.get(x.doc_id, 0) + x.n_words
        bins.setdefault(x.bin_id, []).append(x)
    assert got == words
    for content in bins.values():
        assert sum(x.n_words for x in content) <= 1024 and len({source[x.doc_id] for x in content}) == len(content)
    assert sorted((x.doc_id, x.piece) for x in pack_documents(docs).collect()) == sorted((x.doc_id, x.piece) for x in found)
    texts = pack_texts(docs).collect()
    # the words of a document, in order; rows that share id and text hold the same pieces
    by_doc = {}
    for x in sorted(texts, key=lambda x: x.piece):
        assert len(x.text.split()) == x.n_words or not x.text
        by_doc.setdefault(x.doc_id, []).append(x.text)
    assert all(" ".join(by_doc[d]) == " ".join((t or "").split()) for d, t, _, _ in rows if d != 904) and by_doc[904] == ["twice", "twice"]
    key = lambda x: (x.doc_id, x.piece, x.bin_id, x.bin_offset)
    assert sorted(map(key, texts)) == sorted(map(key, found))
    assert pack_texts(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b", None), (None, "c", None), (None, None, "s")], "doc_id long, text string, source string")
    assert sorted((x.doc_id, x.text) for x in pack_texts(odd).collect()) == [(None, ""), (None, "a b"), (None, "c")]
    assert pack_documents(docs.limit(0)).count() == 0
