"""URL rules by the thousand and licence notices with changed words, against brute force."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from mktlens.llm import license_scan as L
from mktlens.llm import url_filters as U


def _many_rules(n):
    rnd = random.Random(n)
    hosts = [("allow" if i % 5 == 0 else "block", f"h{i}.example", f"/p{i % 7}/" if i % 3 else "/") for i in range(n)]
    patterns = [("block" if i % 4 else "allow", rf"(^|[./-])w{i}[./-]" + "x?" * rnd.randint(0, 3), (f"w{i}",)) for i in range(n)]
    return hosts, patterns


def _urls(n, rules):
    rnd = random.Random(7)
    out = []
    for i in range(n):
        k = rnd.randrange(rules)
        host = rnd.choice([f"H{k}.example", f"a.b.h{k}.example", f"xh{k}.example", f"w{k}.test", "plain.test", f"h{k}.example.w{k + 1}.test"])
        path = rnd.choice(["", f"/p{k % 7}/", f"/P{k % 7}/a", f"/p{k % 7}", f"/w{k}/", f"/a-w{k}-/xx", f"/w{k}x/", "/" + "q/" * 50])
        out.append((i, f"https://{host}{path}{rnd.choice(['', '?w1/', '#w2/'])}"))
    return [*out, (n, None), (n + 1, "no scheme w1/"), (n + 2, "://"), (n + 2, "://"), (n + 3, "s://w1./w2/?x")]


def _brute(url, hosts, patterns):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.lower()
    fits = [(1, len(h + p), h + p, a) for a, h, p in hosts if (host == h or host.endswith("." + h)) and path.startswith(p)]
    fits += [(0, len(p), p, a) for a, p, _ in patterns if re.search(p, (host + path).lower())]
    best = max(fits, default=None)
    return host, path, best[2] if best and best[0] else None, best[3] if best else "allow"


@pytest.mark.parametrize("rules", [20, 3000])
def test_thousands_of_url_rules_against_brute_force(spark, rules):
    hosts, patterns = _many_rules(rules)
    urls = _urls(300, min(rules, 400))
    pages = spark.createDataFrame(urls, "page_id long, url string")
    got = U.judge_urls(pages, hosts, patterns).collect()
    want = [(i, *_brute(u, hosts, patterns)) for i, u in urls]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in got), key=key) == sorted(want, key=key)
    assert {"allow", "block"} <= {r.verdict for r in got} and any(r.rule for r in got)


def test_expressions_run_a_url_do_not_grow_with_the_rules(spark):
    pages = spark.createDataFrame(_urls(300, 100), "page_id long, url string")
    urls = U.parsed(pages)
    run = {}
    for rules in (200, 1000, 5000):  # URLs name the same rules each time
        index = U.rule_index(spark, urls, U.rules_table(*_many_rules(rules)))
        asked = urls.select("page_id", F.explode(U._tokens()).alias("token"))
        run[rules] = asked.join(index, "token").count() / pages.count()
    assert run[200] == run[1000] == run[5000] < 30


def _notice_by_brute_force(words):
    labels, score = set(), 0.0
    for t in L._templates():
        need, key = t["words"], t["key"]
        for start in range(-len(need), len(words) + 1):
            met = sum(0 <= start + k < len(words) and words[start + k] == w for k, w in enumerate(need))
            around = words[max(0, start - 2):start + len(need) + 2]
            has_key = any(around[k:k + len(key)] == key for k in range(len(around)))
            if (met == len(need) and start >= 0) if t["base"] else (met >= math.ceil(L.COVER * len(need)) and has_key):
                labels.add(t["label"])
                score = max(score, met / len(need))
    return labels, score


def test_licence_labels_and_scores_against_brute_force(spark):
    rnd = random.Random(3)
    templates = L._templates()
    vocabulary = sorted({w.decode() for t in templates for w in t["words"]}) + ["filler", "größe", "x9"]
    rows = [(0, None), (1, ""), (2, "   \n"), (3, "The MIT License\n-- mit-license")]
    for i in range(4, 400):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 30))
        for _ in range(rnd.randint(0, 3)):
            notice = [w.decode() for w in rnd.choice(templates)["words"]]
            for _ in range(rnd.choice([0, 0, 1, 2, len(notice) // 5, len(notice) // 5 + 1])):
                notice[rnd.randrange(len(notice))] = rnd.choice(vocabulary)
            cut = rnd.choice([0, 0, 0, 1, 2])  # a notice that the text's start cuts off
            at = 0 if cut else rnd.randint(0, len(words))
            words[at:at] = [w.upper() if rnd.random() < 0.2 else w for w in notice[cut:]]
        rows.append((i, rnd.choice([" ", "\n", ", ", "/"]).join(words)))
    got = {r.doc_id: r for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    seen = set()
    for doc_id, text in rows:
        words = L.text_words(text or "")
        labels, score = _notice_by_brute_force(words)
        places = [s for t in templates if t["base"] for s in range(len(words)) if words[s:s + len(t["words"])] == t["words"]]
        r = got[doc_id]
        assert (r.labels, r.n_base, r.n_words) == (",".join(sorted(labels)), len(places), len(words)), text
        assert r.score == pytest.approx(score) and (r.first_word, r.last_word) == (min(places, default=None), max(places, default=None))
        seen |= labels
    assert seen == {t["label"] for t in templates}


def test_parity_bits_never_show_more_than_the_difference():
    import numpy as np

    from mktlens.llm.shingle_join import PARITY, parity_words
    rnd = np.random.default_rng(1)
    sets = [np.unique(rnd.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 5, 60, 400, 3000) for _ in range(4)]
    sets += [np.unique(np.concatenate([x[len(x) // 10:], rnd.integers(0, 1 << 63, 3, dtype=np.uint64)])) for x in sets]
    words = parity_words(sets)
    assert words.shape == (len(sets), PARITY // 64)
    shown = 0
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            apart = sum(int(a ^ b).bit_count() for a, b in zip(words[i].view(np.uint64).tolist(), words[j].view(np.uint64).tolist(), strict=True))
            really = len(np.setxor1d(x, y))
            assert apart <= really and (apart - really) % 2 == 0
            shown += really > 0 and apart == really
    assert shown > 50 and parity_words([]).shape[0] == 0
