import random

import numpy as np

from pulsequilt.llm import langid

SF = "/root/testdata/sf0.01"


def test_pages_against_their_markup_and_a_plain_fusion(spark):
    pages, docs = spark.read.parquet(f"{SF}/pages.parquet"), spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.page_id: r for r in langid.identify_pages(pages, docs).collect()}
    rows = langid.page_rows(pages).collect()
    assert len(got) == len(rows)
    assert sum(got[r.key].lang == r.declared for r in rows) >= 0.98 * len(rows)
    model = langid.fit_text_model(docs)
    n = len(model.languages)
    seen = {r.key: (*model.judge(r.text), r) for r in rows}
    post = {k: np.exp(v[2]) / np.exp(v[2]).sum() for k, v in seen.items()}
    total = sum(post.values())
    overall = (total + 1 / n) / (total.sum() + 1)

    def soft(field, value):
        return sum((post[k] for k, v in seen.items() if v[3][field] == value), np.zeros(n))

    K = langid.PRIOR_ROWS
    for k, (_, _, log, r) in seen.items():
        domain, host = soft("domain", r.domain) - post[k], sum((post[j] for j, v in seen.items() if v[3].host == r.host and v[3].domain == r.domain), np.zeros(n)) - post[k]
        d = (domain + K * overall) / (domain.sum() + K)
        h = (host + K * d) / (host.sum() + K)
        score = log + np.log(h)
        for field in ("suffix", "declared"):
            if r[field]:
                s = soft(field, r[field])
                score = score + np.log((s + K * overall) / (s.sum() + K) / overall)
        assert got[k].lang == model.languages[int(score.argmax())]
        assert abs(got[k].confidence - 1 / np.exp(score - score.max()).sum()) < 2e-6


def test_priors_decide_where_texts_do_not(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    french = [r.text for r in docs.where("lang = 'fr'").limit(30).collect()]
    rows = [(k, "http://a.example.fr/x", f"<html lang='fr'><p>{t}</p></html>") for k, t in enumerate(french)] + [(100, "http://a.example.fr/y", "<html lang='fr'>de la</html>"), (101, "http://a.example.fr/z", "<p>12 34</p>"), (102, None, None), (None, "::::", "<script>le la les"), (103, "http://u:p@B.example.de:80/q?x#y", "<style>a")]
    got = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), docs).collect()}
    assert got[100].lang == "fr"
    assert got[101].lang == got[102].lang == got[None].lang == got[103].lang == "und"
    assert len(got) == len(rows)


def test_documents_keep_what_can_be_told(spark, awkward, no_documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    r = random.Random(1)
    noise = [(10**6 + k, "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(300)), "en", "src1", 300) for k in range(5)] + [(10**7, "%% 12 !!", "en", "src1", 8), (10**7 + 1, None, "en", "src1", 0)]
    both = docs.unionByName(spark.createDataFrame(noise, docs.schema))
    assert {x.doc_id for x in langid.keep_identified(both).collect()} == {x.doc_id for x in docs.select("doc_id").collect()}
    assert langid.keep_identified(no_documents).count() == 0
    ids = sorted(x.doc_id or 0 for x in langid.keep_identified(awkward).collect())
    assert 1 not in ids and 2 not in ids and 4 in ids and ids.count(5) == 2
    kept = langid.keep_identified(awkward)
    assert kept.columns == awkward.columns and {tuple(r[5:]) for r in kept.collect()} == {tuple(r[5:]) for r in awkward.collect()}


def test_an_empty_table_of_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert langid.identify_pages(spark.read.parquet(f"{SF}/pages.parquet").where("false"), docs).count() == 0


def test_seventy_languages_are_all_told(spark):
    r = random.Random(3)
    letters = [r.sample("abcdefghijklmnopqrstuvwxyzäöüéèñçøåß", 12) for _ in range(70)]
    text = lambda k: " ".join("".join(r.choices(letters[k], k=r.randint(3, 9))) for _ in range(80))
    docs = spark.createDataFrame([(100 * k + j, text(k), f"l{k:02d}", f"src{k % 7}") for k in range(70) for j in range(3)], "doc_id long, text string, lang string, source string")
    assert len(langid.fit_text_model(docs).languages) == 70
    got = {x.doc_id: x.lang for x in langid.identify_documents(docs, docs).collect()}
    assert sum(got[100 * k + j] == f"l{k:02d}" for k in range(70) for j in range(3)) >= 205


def test_the_sample_is_bounded_with_null_and_repeated_ids(spark):
    rows = [(None, f"de la {k}", "fr") for k in range(10_000)] + [(1, "of the", "en")] * 9000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit_text_model(docs, sample=50)
    one = langid.damped(langid.trigram_counts("de la 1234")).sum() / langid.DAMPED_UNIT
    counts = np.exp(model.log_p)
    fr = counts[:, model.languages.index("fr")]
    # the share of a trigram without a count tells how many were counted
    assert 40 * one <= 0.1 / fr.min() - 0.1 * langid.BUCKETS <= 51 * one


def test_markup_is_left_out():
    assert langid.visible("a<b>c</b>d").split() == ["a", "c", "d"]
    assert langid.visible("a<script>x<y</script >b<style>z").split() == ["a", "b"]
    assert langid.visible("a<!-- <b> -->c<!-- open").split() == ["a", "c"]
    for hard in ("<" * 200000, "<script>" * 50000, "<!--" * 50000, "<a " * 100000):
        langid.visible(hard)


def test_no_labels(spark, awkward):
    none = awkward.selectExpr("doc_id", "text", "cast(null as string) lang")
    pages = spark.createDataFrame([(1, "http://x.org", "<p>hello")], "page_id long, url string, html string")
    assert [r.lang for r in langid.identify_pages(pages, none).collect()] == ["und"]
