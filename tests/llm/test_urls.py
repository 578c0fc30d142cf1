import random

import numpy as np

from kalibra.llm import urls

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def test_store_confirms_strings(tmp_path):
    (tmp_path / "s").write_bytes(urls.store_bytes(RULES))
    store = urls.Store(str(tmp_path / "s"))
    key = store.keys[1]
    assert store.find(np.array([key], dtype=np.uint64), [b"not it"]).tolist() == [-1]
    (tmp_path / "e").write_bytes(urls.store_bytes([]))
    assert urls.judged(urls.Store(str(tmp_path / "e")), ["a.net"], ["/"]) == [(None, "allow")]


def test_verdicts(spark):
    rows = [
        (1, "http://A.Example.NET/en/x", "net/ is overruled"),
        (2, "http://example.net/de", ""),
        (3, "http://badexample.com/de/", ""),
        (4, "http://example.com/de/?q#f", ""),
        (5, "http://x.org/fr/y", ""),
        (6, "http://net", ""),
        (7, None, None),
        (8, "no scheme", ""),
        (9, "http://a.net?x=://b.org/fr/", ""),
        (None, "x://" + "y" * 10000 + ".net/", ""),
    ]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge_urls(spark.createDataFrame(rows + rows[:1], "page_id long, url string, rule string"), RULES).collect()}
    assert got == {
        1: ("example.net/en/", "allow"), 2: ("net/", "block"), 3: (None, "allow"), 4: ("example.com/de/", "block"), 5: ("org/fr/", "allow"),
        6: (None, "allow"), 7: (None, "allow"), 8: (None, "allow"), 9: (None, "allow"), None: ("net/", "block"),
    }
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0


def fits(host, path, text):
    own, prefix = text[: text.index("/")], text[text.index("/") :]
    return (host == own or host.endswith("." + own)) and path.startswith(prefix)


def test_equals_brute_force_with_ties(tmp_path):
    rng = random.Random(9)
    label = lambda: rng.choice(["a", "b", "aa", "net", "org"])
    host = lambda n: ".".join(label() for _ in range(rng.randrange(1, n)))
    path = lambda n: "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(n)))
    rules = [(rng.choice(["block", "allow"]), host(4) + path(4)) for _ in range(300)]
    (tmp_path / "s").write_bytes(urls.store_bytes(rules))
    asked = [(host(6), path(6)) for _ in range(3000)] + [("", ""), (".", "/"), ("..a", "/"), ("a.", "/a"), ("a", "")]
    want = []
    for h, p in asked:
        found = [(len(t), t.index("/"), -n, t, v) for n, (v, t) in enumerate(rules) if h and fits(h, p, t)]
        want.append(max(found)[3:] if found else (None, "allow"))
    assert urls.judged(urls.Store(str(tmp_path / "s")), *zip(*asked)) == want


def test_host_of_many_labels_asks_few_strings(tmp_path):
    (tmp_path / "s").write_bytes(urls.store_bytes(RULES))
    store = urls.Store(str(tmp_path / "s"))
    host = "x." * 200_000 + "example.net"
    assert len(urls.candidates(host, "/en/" + "y" * 100_000, store.paths)) <= len(RULES)
    assert urls.judged(store, [host], ["/en/" + "y" * 100_000]) == [("example.net/en/", "allow")]
