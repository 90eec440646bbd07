from __future__ import annotations

import random

from millrace.llm import listing, spam
from tests.conftest import rows

PROSE = (
    "The council in Oxbow replaced 58 worn seats after 12 complaints, while the night crew kept route 21 on the old roads. "
    "If your address changes, tell the registrar within 30 days so that your record stays valid. We took the lid apart with a coin. "
)
NOTES = "Fee 291 paid, receipt missing. Hold lifted Monday, student informed. Form arrived unsigned, returned Friday. Lift Oxbow out again, repair due May. "
PAGES = {
    1: PROSE * 3,
    2: NOTES * 2,
    3: "Winter jacket sale winter jacket near me. Best winter jacket winter jacket buy! " * 4,
    4: "\n".join(f"https://shop{i}.example/item?id={i}" for i in range(20)),
    5: "Tags: " + " ".join(f"brushed ({i})" for i in range(30)),
    6: " | ".join(["Rings", "Silver Bracelet", "Login", "Sitemap", "Page 2", "Offers"] * 4),
    7: PROSE + "\nTags: red (1), blue (2), green (3)",
    8: PROSE + "\n\n" + "Looking for visa help? visa help is the visa help that visa help buyers call the best visa help. " * 12,
    9: "How much is a ring? Where to buy a ring in Oxbow? Is a ring the best ring for me? What is the price of the ring?",
    10: "",
    11: None,
    12: "".join(f"Oxbow {x}. " for x in ("has two shelters, though only one is lit", "gets busy after six, but there is room", "is shared by two routes", "is closed on Sunday")),
    13: "Acme woven tote 79.99\nBrio soft lamp -20% off\nCabo slim ring SKU1376\nDelo matte boot size 8253",
    14: PROSE * 400,
    15: "sneakers cheap deal " * 4000,
}
SPAM = {3, 4, 5, 6, 8, 9, 13, 15}


def _docs(spark, pages):
    return spark.createDataFrame([(i, t, f"h{i}" if i % 3 else None, 1, "x") for i, t in pages], "doc_id bigint, text string, site string, size int, words string")


def test_pages(spark):
    pages = list(PAGES.items()) + [(100 + i, t) for i, t in PAGES.items()] + [(3, PAGES[3])]
    got = spam.spam_pages(_docs(spark, pages))
    assert {r.doc_id for r in got.collect()} == SPAM | {100 + i for i in SPAM}
    assert got.count() == 2 * len(SPAM)


def test_empty_table(spark):
    assert spam.spam_pages(_docs(spark, [(1, "x")]).limit(0)).count() == 0


def _brute(pages, hosts=3):
    """Scores by dictionaries: (density, score) of every page."""
    found, seen = {}, {}
    for i, t in pages:
        site = f"h{i}" if i % 3 else ""
        own, size, listed = {}, 0, 0
        for words, chars, is_list, decided in listing.pieces(t):
            if words:
                n = max(1, len(words) - 4)
                chars = max(n, chars // n * n)
                for k in range(n):
                    phrase = tuple(words[k : k + 5])
                    got = own.setdefault(phrase, [0, 0, False, False])
                    got[0] += chars // n
                    got[1] += chars // n if is_list else 0
                    got[2] |= decided and is_list
                    got[3] |= decided and not is_list
                    at = seen.setdefault(phrase, {}).setdefault(site, [False, False])
                    at[0] |= decided and is_list
                    at[1] |= decided and not is_list
            size += chars
            listed += chars if is_list else 0
        found[i] = own, size, listed
    out = {}
    for i, (own, size, listed) in found.items():
        moved = 0
        for phrase, (chars, as_list, in_list, stated) in own.items():
            at = seen[phrase].values()
            if len(at) >= hosts:
                lists, states = sum(x[0] for x in at) - in_list, sum(x[1] for x in at) - stated
                looks = as_list * 2 > chars
                others = len(at) - 1
                moved += chars if lists * 2 > others and not looks else -chars if states * 2 > others and looks else 0
        out[i] = (round(listed / size, 9), round(min(max(listed + moved, 0), size) / size, 9)) if size else (0.0, 0.0)
    return out


def test_scores_by_brute_force(spark):
    rng = random.Random(2)
    parts = [PROSE, NOTES, PAGES[3], PAGES[6], PAGES[9], PAGES[12], "red ring, blue hat, best price near me\n", "The red ring is where it was. ", ""]
    parts += ["how much is a ring in oxbow\nwhere to buy a ring in oxbow"] * 3 + ["How much is a ring in oxbow. Where to buy a ring in oxbow."]
    pages = [(i, "\n\n".join(rng.choice(parts) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    got = spam.score_pages(_docs(spark, pages), "doc_id", "text", "site").collect()
    want = _brute(pages)
    assert {r.doc_id: (round(r.density, 9), round(r.score, 9)) for r in got} == want
    assert any(a != b for a, b in want.values())


def test_phrases_of_other_hosts_decide(spark):
    asked = "how much is a ring in oxbow\nwhere to buy a ring in oxbow\nwho has the best ring in oxbow"
    stated = "How much is a ring in oxbow. Where to buy a ring in oxbow. Who has the best ring in oxbow."
    docs = _docs(spark, [(1, asked), (2, asked), (4, asked), (5, stated), (7, stated + " " + PROSE)])
    got = {r.doc_id: r for r in spam.score_pages(docs, "doc_id", "text", "site").collect()}
    assert got[5].density < 0.5 < got[5].score
    assert got[7].score < 0.5
    alone = {r.doc_id: r for r in spam.score_pages(_docs(spark, [(5, stated)]), "doc_id", "text", "site").collect()}
    assert alone[5].score == alone[5].density < 0.5


def test_phrases_are_laid_out_once(spark):
    plan = spam.score_pages(_docs(spark, PAGES.items()), "doc_id", "text", "site")
    plan.collect()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in text or "AQEShuffleRead" in text
    assert text.split("Initial Plan")[0].count("MapInArrow") == 1


def test_scores_have_one_row_per_document(spark):
    docs = _docs(spark, PAGES.items())
    scored = spam.score_pages(docs, "doc_id", "text", "site")
    assert rows(scored, "doc_id") == sorted([(i,) for i in PAGES], key=repr)
