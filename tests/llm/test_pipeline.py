"""The pipeline's stages on their own input, and the whole of it."""

import corpus_pipeline as p
from chronofold.llm.common import stored
from tests.llm import brute
from tests.llm.conftest import SF
from tests.llm.test_tokens import check_packing


def texts_of(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_stages_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES[:-1]:
        before, after = texts_of(docs), stored(stage(spark, docs, SF))
        assert after.columns == columns
        kept = dict(texts_of(after))
        if name == "language_id":
            assert set(kept) == {i for i, t in before if t and any(c.isalpha() for c in t)}
        elif name == "near_dedup":
            assert set(kept) == {i for i, (_, least) in brute.near_groups(before, 5).items() if i == least}
        elif name == "suffix_dedup":
            _, later = brute.repeats(before)
            want = {i: [w for k, w in enumerate(t.encode().split()) if k not in later[i]] for i, t in before}
            assert {i: t.encode().split() for i, t in kept.items()} == {i: w for i, w in want.items() if w}
        else:
            items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(kept) == {i for i, x in brute.contamination(before, items).items() if not x[4]}
        docs = after
    rows = p.STAGES[-1][1](spark, docs, SF).collect()
    check_packing(rows, texts_of(docs))
    whole = p.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


FOREIGN = [
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "qzxv wkjq bzzt xqpl vvmr kjhg zxcv qwpo mnbv lkjh gfds pqow zmxn",
    "Все люди рождаются свободными и равными в своем достоинстве и правах",
]


def test_unknown_languages_go_and_known_ones_stay(spark):
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    planted = spark.createDataFrame([(-1 - k, t, None, "x", len(t)) for k, t in enumerate(FOREIGN)], docs.schema)
    kept = {r.doc_id for r in p.keep_known_languages(spark, docs.unionByName(planted), SF).select("doc_id").collect()}
    assert kept == {i for i, t in texts_of(docs) if t and any(c.isalpha() for c in t)}


def test_rows_that_share_an_id(spark):
    """Each stage keeps or cuts them by what its docstring says."""
    from tests.llm.conftest import SCHEMA, prose

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if len(brute.words(r.text)) >= 10]
    passage = prose(77, 60)
    rows = [(1, f"{passage} {prose(1, 30)}"), (2, f"{prose(2, 40)} {passage}"), (2, prose(4, 150)), (2, prose(4, 150)), (3, prose(5, 50)), (3, items[0]), (4, None), (None, prose(6, 30)), (None, prose(6, 30))]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], SCHEMA)
    near = texts_of(p.drop_near_duplicates(spark, docs, SF))
    assert sorted(i for i, _ in near if i) == [1, 2, 3, 4] and len(near) == 6
    cut = texts_of(p.drop_repeated_passages(spark, docs, SF))
    assert len(cut) == len(rows) and sorted(len(t.split()) for i, t in cut if i == 2) == [40, 150, 150]
    clean = texts_of(p.drop_contaminated(spark, docs, SF))
    assert {i for i, _ in clean} == {1, 2, 4, None} and len(clean) == len(rows) - 2


def test_stages_of_odd_rows(spark, odd_docs, no_docs):
    docs, empty = odd_docs, no_docs
    for _, stage in p.STAGES[:-1]:
        columns = docs.columns
        docs, empty = stored(stage(spark, docs, SF)), stored(stage(spark, empty, SF))
        assert docs.columns == columns and empty.count() == 0
    ids = [r.doc_id for r in docs.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {0, 5, 8, 9} <= set(ids) and not {1, 2, 3, 4, 6} & set(ids)
    assert p.STAGES[-1][1](spark, docs, SF).count() > 0 and p.STAGES[-1][1](spark, empty, SF).count() == 0
