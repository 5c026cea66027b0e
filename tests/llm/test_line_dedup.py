import re

from pyspark.sql import functions as F

from kanaforge.llm import line_dedup as L

from .conftest import ODD_ROWS


def brute(rows, min_sites, max_percent=80):
    """(id, text, removed lines) by definition; rows: (id, text, lang, site)."""
    bare = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", x)
    sites = {}
    for _, text, _, site in rows:
        for line in (text or "").split("\n"):
            if bare(line) and site is not None:
                sites.setdefault(bare(line), set()).add(site)
    out = []
    for i, text, _, _ in rows:
        if text is None:
            out.append((i, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if len(sites.get(bare(x), ())) < min_sites]
        cut = 100 * sum(map(len, kept)) >= (100 - max_percent) * sum(map(len, lines))
        out.append((i, "\n".join(kept), len(lines) - len(kept)) if cut else (i, text, 0))
    return out


def got(docs, min_sites, max_percent=80):
    cut = L.drop_boilerplate(docs, min_sites=min_sites, max_percent=max_percent, removed_as="n_removed")
    return sorted(((r["doc_id"], r["text"], r["n_removed"]) for r in cut.collect()), key=str)


def test_spread_decides_not_frequency(make_docs):
    rows = [(i, f"own line {i}\n  shared everywhere \n\nshared on two sites {i % 2}\n", "en", f"site{i % 20}") for i in range(60)]
    rows += [(100 + i, "often on one site\nrest", "en", "site1") for i in range(50)]
    assert got(make_docs(rows), 12) == sorted(brute(rows, 12), key=str)
    assert all(n == 1 for i, _, n in got(make_docs(rows), 12) if i < 100)


def test_exact_near_the_threshold(make_docs):
    rows = [(k * 1000 + i, f"line of {k} sites\nx{k * 1000 + i}", "en", f"s{i}") for k in (198, 199, 200, 201, 240) for i in range(k)]
    for threshold in (200, 201):
        cut = {t.split("\n")[0] for _, t, n in got(make_docs(rows, clash=False), threshold, 100) if not n}
        assert cut == {f"line of {k} sites" for k in (198, 199, 200, 201, 240) if k < threshold}


def test_hot_line_and_odd_rows(make_docs, no_docs):
    rows = [r if len(r) == 4 else (*r, "en", "s") for r in ODD_ROWS] + [(500 + i, "menu\nhome", "en", f"t{i}") for i in range(5)] + [(600, "menu", None, None)]
    for max_percent in (100, 80, 0):
        assert got(make_docs(rows), 2, max_percent) == sorted(brute(rows, 2, max_percent), key=str)
    out = L.drop_boilerplate(make_docs(rows), min_sites=2)
    assert out.columns == make_docs(rows).columns
    assert L.drop_boilerplate(no_docs).count() == 0


def test_a_copied_document_is_not_boilerplate(make_docs):
    story = "\n".join(f"a line of a much copied story, number {i}" for i in range(10))
    rows = [(i, story if i % 2 else story.replace("number 3", f"number {i}"), "en", f"s{i}") for i in range(20)]
    rows += [(100 + i, f"menu of the site\na story of its own {i}", "en", f"s{i}") for i in range(20)]
    texts = {i: t for i, t, _ in got(make_docs(rows), 10)}
    assert all(texts[i] == t for i, t, _, _ in rows[:20])
    assert all(texts[100 + i] == f"a story of its own {i}" for i in range(20))


def test_only_copies_keep_boilerplate(spark, make_docs):
    """Short pages of menu lines lose them as long ones do; copies, near ones too, keep theirs."""
    import corpus_pipeline

    menu = "a long line that the menus of all the sites have in common"
    story = "\n".join(f"a line of a much copied story, number {i}" for i in range(10))
    page = "\n".join(f"a line of the page {{0}}, number {i}" for i in range(10))
    rows = [(i, f"{menu}\n{page.format(i)}", "en", f"s{i}") for i in range(20)]
    rows += [(100 + i, f"{menu}\nown {i}\n {menu}", "en", f"s{i}") for i in range(20)] + [(None, f"{menu}\nno id", "en", "s1"), (200, menu, "en", "s1"), (201, None, "en", "s1")]
    rows += [(300 + i, story if i % 2 else story.replace("number 3", f"number {i}"), "en", f"s{i}") for i in range(20)]
    rows += [(400, f"{story}\n{menu}", "en", "s1")]
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, make_docs(rows), "")
    want = [(i, t and "\n".join(x for x in t.split("\n") if x.strip() != menu)) for i, t, _, _ in rows]
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == sorted(want, key=str)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_threshold_follows_few_sites(spark, make_docs, no_docs):
    import corpus_pipeline

    page = "\n".join(f"a line of the page {{0}}, number {i}" for i in range(10))
    rows = [(i, f"on all sites\n{page.format(i)}" + ("\non four sites" if i % 6 < 4 else ""), "en", f"s{i % 6}") for i in range(30)]
    out = dict(corpus_pipeline.STAGES)["line dedup"](spark, make_docs(rows), "")
    assert sorted((r["doc_id"], r["text"]) for r in out.collect()) == [(i, t.replace("on all sites\n", "")) for i, t, _, _ in rows]
    sites = lambda n: L.site_threshold(make_docs([(i, "x", "en", f"s{i}") for i in range(n)]))
    assert [sites(n) for n in (1, 4, 6, 10, 19, 20, 40)] == [3, 3, 5, 8, 15, 15, 15] and L.site_threshold(no_docs) == 3


def test_no_python_in_the_plan(make_docs):
    plan = L.drop_boilerplate(make_docs(ODD_ROWS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "hll_sketch_agg" in plan


def test_null_site_counts_for_nothing(make_docs):
    rows = [(i, "same\nx", "en", None) for i in range(9)] + [(50, "same\nx", "en", "a")]
    assert {r["text"] for r in L.drop_boilerplate(make_docs(rows), min_sites=2, max_percent=100).select(F.col("text")).collect()} == {"same\nx"}


def test_removed_as_replaces_a_column(make_docs):
    from kanaforge.llm import line_dedup

    docs = make_docs([(i, "menu\n" + f"own line {i} " * 9, "en", f"s{i}") for i in range(20)])
    got = line_dedup.drop_boilerplate(docs, min_sites=15, removed_as="KEPT")
    assert got.columns == [c for c in docs.columns if c != "kept"] + ["KEPT"]
    assert {r["KEPT"] for r in got.collect()} == {1}
