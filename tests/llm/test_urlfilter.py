import random
import re

import numpy as np

from ruleweave.llm import urlfilter as U


def _regex(glob: str) -> re.Pattern:
    out = re.escape(glob).replace(r"\*\*", "\0").replace(r"\*", "[^/]*").replace("\0", ".*")
    return re.compile(out, re.S)


def test_automaton_equals_regular_expressions():
    r = random.Random(1)
    globs = ["".join(r.choice(["a", "b", "/", ".", "*", "**"]) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    globs = [re.sub(r"\*{3,}", "**", g) for g in globs]
    urls = ["".join(r.choice("ab/.") for _ in range(r.randrange(0, 40))) for _ in range(300)] + ["a" * 5000 + "/b", ""]
    m = U.ShiftAnd(globs)
    assert m.words > 1
    data = np.frombuffer("".join(urls).encode(), dtype=np.uint8)
    off = np.cumsum([0, *map(len, urls)])
    hits = m.run(data, off)
    want = [[bool(_regex(g).fullmatch(u)) for g in globs] for u in urls]
    assert hits.tolist() == want
    assert m.run(data, off, few=10**6).tolist() == want  # one by one


CASES = {
    "https://www.example.com/en/1?x=/es/": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "http://EXAMPLE.com/en/": ("example.com", "/en/", "example.com/en/", "block"),
    "http://a.b.example.com/en/x#f": ("a.b.example.com", "/en/x", "example.com/en/", "block"),
    "http://notexample.com/en/x": ("notexample.com", "/en/x", "com/", "allow"),
    "http://example.com/EN/x": ("example.com", "/EN/x", "com/", "allow"),
    "http://com": ("com", "", None, "allow"),
    "http://x.net/fr/": ("x.net", "/fr/", "net/fr/", "block"),
    "http://x.net/a.com/es/": ("x.net", "/a.com/es/", None, "allow"),
    "http://x.net:80/es/": ("x.net:80", "/es/", None, "allow"),
    "http://www.casino-x.org/": ("www.casino-x.org", "/", None, "block"),
    "http://x.org/a/setup.exe": ("x.org", "/a/setup.exe", None, "block"),
    "no scheme.com/": ("", "", None, "allow"),
    "a://b://c.com/": ("b:", "//c.com/", None, "allow"),
    "": ("", "", None, "allow"),
}


def test_rules_and_awkward_urls(spark):
    rows = [(i, u, "own", "v") for i, u in enumerate(CASES)] + [(99, None, "own", "v"), (99, None, "own", "v")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string")
    got = U.url_filter(df).collect()
    assert len(got) == len(rows)
    by = {r.url: r for r in got}
    for u, want in CASES.items():
        assert (by[u].host, by[u].path, by[u].rule, by[u].verdict) == want, u
    assert (by[None].host, by[None].path, by[None].rule, by[None].verdict) == ("", "", None, "allow")
    assert U.url_filter(df.limit(0)).count() == 0
    assert U.url_filter(df, host_rules=(), block_globs=()).where("verdict <> 'allow'").count() == 0
