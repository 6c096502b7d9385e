import math
import random
from collections import Counter

from pyspark.sql import functions as F

from quillspark.llm import url_filters as uf

SCHEMA = "page_id long, url string, html string, host long, blocked string, n int, depth string"


def pages(spark, tmp_path, rows):
    path = str(tmp_path / str(random.random()))
    spark.createDataFrame([(i, u, "x", 1, "y", 2, "z") for i, u in rows], SCHEMA).repartition(2).write.parquet(f"{path}/pages.parquet")
    return path


def got(spark, path):
    return sorted((tuple(r) for r in uf.op13_url_filters(spark, path).collect()), key=repr)


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[end:]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def binned(x, step):
    return min(15, max(0, math.floor(x / step)))


def brute(rows):
    """Rules by plain loops; trees grown by looking at every split of every feature over single rows."""
    urls = [(i, u or "", *split(u), *ruled(*split(u))) for i, u in rows]
    label = [{"block": 1, "allow": 0}.get(r[5]) for r in urls]
    seen, labelled, blocked = Counter(), Counter(), Counter()
    suffixes = [(".".join(r[2].split(".")[-1:]), ".".join(r[2].split(".")[-2:])) for r in urls]
    for pair, y in zip(suffixes, label, strict=True):
        for s in set(pair):
            seen[s] += 1
            labelled[s] += y is not None
            blocked[s] += y or 0
    known_labels = [y for y in label if y is not None]
    prior = sum(known_labels) / max(1, len(known_labels))
    known = {s: binned((blocked[s] + prior * (seen[s] - labelled[s] + uf.PRIOR_ROWS)) / (seen[s] + uf.PRIOR_ROWS), 1 / 16) for s in seen}
    x = []
    for (_, u, host, path, _, _), (last, domain) in zip(urls, suffixes, strict=True):
        h = -sum(c / len(u) * math.log2(c / len(u)) for c in Counter(u).values()) if u else 0.0
        query = u.split("?", 1)[1].split("#")[0] if "?" in u else ""
        x.append({
            "url_length": binned(len(u), 6), "host_length": binned(len(host), 3), "path_length": binned(len(path), 2), "depth": binned(len([p for p in path.split("/") if p]), 1),
            "labels": binned(len(host.split(".")), 1), "digits": binned(sum(c in "0123456789" for c in u) / max(1, len(u)), 0.04), "entropy": binned(h - 2, 0.25),
            "parameters": binned(len([p for p in query.split("&") if p]), 1), "last_known": known[last], "last_seen": binned(math.log2(seen[last]), 2),
            "domain_known": known[domain], "domain_seen": binned(math.log2(seen[domain]), 2),
        })
    if not known_labels or sum(known_labels) in (0, len(known_labels)):
        odds = [math.inf if sum(known_labels) else -math.inf] * len(x)
    else:
        odds = [math.log(sum(known_labels) / (len(known_labels) - sum(known_labels)))] * len(x)
        for _ in range(uf.TREES):
            p = [math.floor(65536 / (1 + math.exp(-s)) + 0.5) for s in odds]
            g = [q - y * 65536 if y is not None else 0 for q, y in zip(p, label, strict=True)]
            h = [q * (65536 - q) // 65536 for q in p]

            def grow(own, depth, g=g, h=h):
                train = [i for i in own if label[i] is not None]
                sums = lambda rows: (sum(g[i] for i in rows) / 65536, sum(h[i] for i in rows) / 65536)
                part = lambda rows: (lambda a, b: a * a / (b + 1.0))(*sums(rows))
                best, at = 1e-9, None
                for f in uf.FEATURES if depth < uf.DEPTH else ():
                    for e in sorted({x[i][f] for i in train})[:-1]:
                        gain = part([i for i in train if x[i][f] <= e]) + part([i for i in train if x[i][f] > e]) - part(train)
                        if gain > best:
                            best, at = gain, (f, e)
                if at is None:
                    a, b = sums(train)
                    return dict.fromkeys(own, -0.3 * a / (b + 1.0))
                return grow([i for i in own if x[i][at[0]] <= at[1]], depth + 1) | grow([i for i in own if x[i][at[0]] > at[1]], depth + 1)

            step = grow(range(len(x)), 0)
            odds = [s + step[i] for i, s in enumerate(odds)]
    return sorted(((i, host, path, rule, verdict or ("block" if s > 0 else "allow")) for (i, _, host, path, rule, verdict), s in zip(urls, odds, strict=True)), key=repr)


def invented(n, rng):
    hosts = ["a.example.net", "www.example.com", "EXAMPLE.com", "x.org", "org", "ads.track.example.com", "b.net", "news.site.info", "1234567.biz"]
    paths = ["/en/1", "/de/22", "/fr/", "/de", "", "/a/b/c/d", "/EN/x.html"]
    tails = ["", "?a=1", "?a=1&b=2&&c", "#top", "?x#y", "?utm_source=feed&id=99999999"]
    return [(i, f"{rng.choice(['http', 'https'])}://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(tails)}") for i in range(n)]


def test_agrees_with_brute_force(spark, tmp_path):
    rng = random.Random(5)
    rows = invented(400, rng) + [(1, "http://b.net/x")] * 150 + [(None, "http://x.org/fr/"), (900, None), (901, ""), (902, "no scheme /x"), (903, "://"), (904, "a\nb://H.ORG\n/fr/"), (905, "x://y://net/")]
    rows += [(906, "http://u:p@example.com:80/de/"), (907, "http://İ.net/"), (908, "http://a.net/" + "z/" * 30000), (909, "http://notexample.net?/en/"), (910, "http://example.net/en/")]
    assert got(spark, pages(spark, tmp_path, rows)) == brute(rows)


def test_no_labels_one_label_no_rows(spark, tmp_path):
    for rows in ([], [(1, "http://a.com/x"), (2, None)], [(1, "http://a.net/"), (2, "http://a.com/q")], [(1, "http://org/fr/x"), (2, "")]):
        assert got(spark, pages(spark, tmp_path, rows)) == brute(rows)


def test_longest_rule_wins(spark):
    rules = (("com", "/", "block"), ("a.com", "/x", "allow"), ("b.a.com", "/", "block"), ("com", "/abcde", "allow"))
    rows = spark.createDataFrame([("b.a.com", "/x"), ("a.com", "/xy"), ("a.com", "/"), ("ba.com", "/x"), ("z.com", "/abcdef"), ("com", "")], "host string, path string")
    rule, verdict = uf.matched(F.col("host"), F.col("path"), rules)
    assert [tuple(r) for r in rows.select(rule, verdict).collect()] == [("b.a.com/", "block"), ("a.com/x", "allow"), ("com/", "block"), ("com/", "block"), ("com/abcde", "allow"), (None, None)]


def test_held_out_labels_are_found(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    rows = []
    for i in range(3000):
        bad = i % 3 == 0
        url = f"http://{word(4)}.{rng.choice(['top', 'com'] if bad else ['com', 'com', 'org'])}/" + (f"{rng.randrange(10**9)}?id={rng.randrange(10**6)}&s=1&t=2" if bad and i % 2 else f"{word(6)}/{word(5)}.html")
        rows.append((i, url, None if i % 5 == 0 else int(bad), int(bad)))
    table = spark.createDataFrame(rows, "page_id long, url string, blocked int, truth int")
    table = uf.with_features(table.withColumns({"host": uf.host_of(F.col("url")), "path": uf.path_of(F.col("url"))}))
    model = uf.fit(table)
    held = table.where("blocked IS NULL").select("truth", (model.score() > 0).cast("int").alias("said"))
    assert held.where("truth = said").count() / held.count() > 0.85
    assert [uf.fit(table.repartition(n)).trees for n in (1, 3)] == [model.trees] * 2


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = uf.op13_url_filters(spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))
