import pytest

from pairloom.llm import urls
from pairloom.llm.urls import Rule

SCHEMA = "page_id long, url string, host string, verdict int, rule string"
RULES = [Rule("allow", "Org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("block", "sub.example.org", ""),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"), Rule("block", "münchen.de", "/ä")]
URLS = [None, "", "no scheme/x", "http://A.Example.ORG/es/1?q#f", "https://example.org/es", "x://example.org/en/12", "http://example.org", "http://sub.example.org",
        "http://a.sub.example.org/es/", "http://badexample.org/es/", "http://x.com/fr/", "http://x.com/de/://y.org/", "http://com/de/", "://org/", "http:///path",
        "http://münchen.de/äö", "http://MÜNCHEN.de/ä", "http://org:80/", "http://x.org?/es/", "a\nb://example.org/es/\nx", "http://.org/", "http://" + "a." * 5000 + "org/" + "p" * 9000]


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    path = path[:min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [(len(r.host + r.path), len(r.host), r.host.lower() + r.path, r.verdict) for r in RULES
            if (host == r.host.lower() or host.endswith("." + r.host.lower())) and path.startswith(r.path)]
    best = max(fits, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_rules(table):
    rows = [(i, u, "h", 1, "r") for i, u in enumerate(URLS)] + [(None, URLS[3], "h", 1, "r"), (3, URLS[3], "h", 1, "r")]
    got = urls.judge(table(rows, SCHEMA), RULES).collect()
    assert sorted((tuple(r) for r in got), key=repr) == sorted(((r[0], *judged(r[1])) for r in rows), key=repr)
    assert urls.judge(table([], SCHEMA), RULES).collect() == []
    assert {r["verdict"] for r in urls.judge(table(rows, SCHEMA), [], default="block").collect()} == {"block"}


def test_equal_digests_are_told_apart(monkeypatch, tmp_path):
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda s: len(s) % 2)
    index = urls.DigestIndex(RULES)
    path = tmp_path / "rules"
    path.write_bytes(index.content)
    names = [f"{r.host.lower()}\n{r.path}" for r in RULES] + ["com\n/xx/", "q\n", ""]
    assert urls.Probe(str(path)).find(names) == [r.verdict for r in RULES] + [None] * 3


def test_bad_rules(monkeypatch):
    with pytest.raises(ValueError):
        urls.DigestIndex([Rule("maybe", "a", "/")])
    with pytest.raises(ValueError):
        urls.DigestIndex([Rule("allow", "a", "/"), Rule("block", "A", "/")])
    monkeypatch.setattr(urls, "MOST_BYTES", 10)
    with pytest.raises(ValueError):
        urls.DigestIndex(RULES)
