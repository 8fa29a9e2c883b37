"""Stems against known words, and the index kept by deltas against one built anew."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import stemming
from siltstone.operators import retrieval
from siltstone.sources import lexical_index

STEMS = """в в|вавиловка вавиловк|вагнера вагнер|вагоне вагон|вагонов вагон|важнее важн|важнейшие важн|важнейшими важн|важничал важнича|важность важност|важностию важност|важному важн|вазах ваз
вакханка вакханк|валандался валанда|валериановых валерианов|валерию валер|валетами валет|па па|павлиний павлин|павлиньи павлин|павлиньим павлин|павлович павлович|павловцы павловц|падает пада|падаль падал
падают пада|падающего пада|падающие пада|падение паден|падением паден|падений паден|паденья паден|падет падет|падут падут|падчерицей падчериц|падшему падш|падших падш|паек паек|пазухи пазух|пазуху пазух"""


def test_stems_of_known_words(spark):
    pairs = [tuple(p.split()) for line in STEMS.splitlines() for p in line.split("|")]
    df = spark.createDataFrame(pairs, "word string, stem string").withColumn("got", stemming.russian_stem(F.col("word")))
    assert [(r["word"], r["got"]) for r in df.collect()] == pairs


def test_terms_of_queries_and_texts(spark):
    texts = [("Все ВАЖНЕЙШИЕ вагоны и Wagons 42, ёлка_1",), ("",), (None,), ("и в не",), ("ь ы нн",)]
    got = [r[0] for r in spark.createDataFrame(texts, "text string").select(stemming.russian_terms(F.col("text"))).collect()]
    assert got == [["важн", "вагон", "wagons", "42", "елка_1"], [], None, [], ["ь", "ы", "нн"]]


def test_endings_take_the_longest_first():
    assert stemming.ending(("", "а ба")) == "(?:(?:ба|а))$"
    assert stemming.ending(("б аб", "в")) == "(?:(?<=[ая])(?:аб|б)|(?:в))$"


def rows(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


@pytest.fixture
def index(spark, tmp_path):
    return lexical_index.LexicalIndex(spark, f"file://{tmp_path}/index")


def frame(spark, docs):
    return spark.createDataFrame(list(docs.items()), "key bigint, text string")


def same_as_rebuilt(spark, index, docs, tmp_path, name):
    other = lexical_index.LexicalIndex(spark, f"file://{tmp_path}/{name}")
    other.update(1, frame(spark, docs))
    assert index.size() == pytest.approx(other.size())
    assert rows(index.frequencies(), "term", "df") == rows(other.frequencies(), "term", "df")
    assert rows(index.postings(), "term", "key", "tf", "dl") == rows(other.postings(), "term", "key", "tf", "dl")
    assert rows(index.documents(), "key", "hash") == rows(other.documents(), "key", "hash")


def test_every_batch_equals_a_rebuild(spark, index, tmp_path):
    rng, docs = random.Random(19), {}
    words = ["alpha", "beta", "gamma", "delta", "eps", "Alpha", ",", ""]
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))] + [" ".join(rng.choices(words, k=5))] * 4)
    for batch in range(1, 5):
        upserts = {k: text() for k in rng.sample(range(12), 5)}
        deletes = rng.sample(range(12), 2)
        assert index.update(batch, frame(spark, upserts), spark.createDataFrame([(k,) for k in deletes], "key bigint"))
        docs |= upserts
        docs = {k: v for k, v in docs.items() if k not in deletes}
        same_as_rebuilt(spark, index, docs, tmp_path, f"again{batch}")
    assert not index.update(4, frame(spark, {99: "replayed"}))
    with pytest.raises(ValueError):
        index.update(0, frame(spark, {99: "too late"}))
    assert index.compact(10)
    same_as_rebuilt(spark, index, docs, tmp_path, "compacted")
    index.update(11, frame(spark, {0: "alpha omega"}))
    same_as_rebuilt(spark, index, docs | {0: "alpha omega"}, tmp_path, "later")


def test_a_batch_that_dies_is_not_seen(spark, index, tmp_path, monkeypatch):
    index.update(1, frame(spark, {1: "alpha", 2: "beta"}))

    def die(*args):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(lexical_index, "put_new", die)
        with pytest.raises(OSError):
            index.update(2, frame(spark, {1: "gamma"}))
    same_as_rebuilt(spark, index, {1: "alpha", 2: "beta"}, tmp_path, "a")
    index.update(2, frame(spark, {1: "delta"}))
    same_as_rebuilt(spark, index, {1: "delta", 2: "beta"}, tmp_path, "b")


def test_search_equals_bm25_over_the_texts(spark, index):
    docs = {1: "red fox runs", 2: "red red dog", 3: "blue fox", 4: "", 5: "dog dog dog dog"}
    index.update(1, frame(spark, docs | {6: "red fox fox"}))
    index.update(2, frame(spark, {}), spark.createDataFrame([(6,)], "key bigint"))
    asked = spark.createDataFrame([(1, "red fox"), (2, "dog"), (3, "nothing")], "item bigint, text string")
    want = retrieval.bm25(frame(spark, docs), asked.withColumnRenamed("text", "q"), "key", "text", "item", "q", 3)
    assert rows(index.search(asked, "item", "text", 3), "item", "key", "score", "rank") == rows(want, "item", "key", "score", "rank")


def test_an_update_shuffles_no_words_of_new_texts(spark, index):
    """Terms are counted in a text's row, and a term's documents are laid down together."""
    docs = {i: f"alpha beta w{i % 7} alpha" for i in range(70)}
    index.update(1, frame(spark, docs).coalesce(1))
    blocks = index._read("postings", lexical_index._POSTINGS)
    assert blocks.count() == 9 and {r["n"] for r in blocks.where("term LIKE 'w%'").collect()} == {10}
    assert rows(index.postings().where("term = 'alpha'"), "key", "tf", "dl") == [(i, 2, 4) for i in range(70)]
    index.update(2, frame(spark, {0: "beta", 1: docs[1]}), spark.createDataFrame([(2,), (99,)], "key bigint"))
    assert rows(index._read("postings", lexical_index._POSTINGS).where("batch = 2"), "term", "n", "sign") == [("alpha", 2, -1), ("beta", 1, 1), ("beta", 2, -1), ("w0", 1, -1), ("w2", 1, -1)]
    assert index.size() == (69, (68 * 4 + 1) / 69)
