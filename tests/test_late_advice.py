"""Credits and advice as streams, in several orders of arrival, against the batch."""

import datetime
import itertools
import time

from pyspark.sql import functions as F

from creditweave.config import DEFAULT
from creditweave.operators import book
from creditweave.plans import extract
from creditweave.streaming import advice as late
from tests.test_engine import DAY, make

CREDITS = "statement_ref string, amount_paise long, value_date date, payer_name_normalized string, normalized_narration string"
ADVICE = f"statement_ref string, remittance_id long, received_at timestamp, method string, reconciled boolean, references array<string>, lines array<{extract.LINE}>, claimed_reason string"


def day(n):
    return DAY + datetime.timedelta(days=n)


def at(n):
    return datetime.datetime.combine(day(n), datetime.time())


def rows():
    credits = [("U0", 4185000, day(0), "abc traders", "NEFT"), ("U1", 100000, day(0), "stranger", "NEFT"), ("U2", 250000, day(1), "abc traders", "NEFT"), ("U3", 777, day(1), "nobody", "NEFT")]
    doc = lambda ref, i, n, number: (ref, i, at(n), "mock", True, [number], [], None)
    advice = [
        doc("U0", 1, -2, "INV42"),  # early, in time
        doc("U1", 2, 3, "INV43"), doc("U1", 3, 0, "INV44"),  # the earlier document decides, though it comes last
        doc("U2", 4, 5, "INV44"),  # too late: received four days after
        doc("U9", 5, 0, "INV42"), (None, 6, at(0), "mock", True, ["INV42"], [], None),
    ]
    return credits, advice


def shape(df):
    first = F.get("candidates", F.lit(0))["allocations"]
    return sorted((r["statement_ref"], r["strategy"], tuple(r["n"] or ())) for r in df.select("statement_ref", "strategy", F.transform(first, lambda a: a["invoice_number"]).alias("n")).collect())


def test_streams_decide_as_the_batch_does_in_any_order(spark, tmp_path):
    inv, _, names, aliases = make(spark, [(42, 1, 41850), (43, 1, 1000), (44, 1, 2500)], [])
    items = book.open_items(inv)
    credits, advice = rows()
    whole = late.hold(spark.createDataFrame(credits, CREDITS), spark.createDataFrame(advice, ADVICE))
    assert {r["statement_ref"]: sorted(d["remittance_id"] for d in r["documents"]) for r in whole.collect()} == {"U0": [1], "U1": [2, 3], "U2": [], "U3": []}
    want = shape(late.decide(whole, items, names, aliases, fuzzy=False))
    assert ("U0", "remittance_guided", ("INV-00042",)) in want and ("U1", "remittance_guided", ("INV-00043",)) in want and ("U2", "amount_exact", ("INV-00044",)) in want
    far = [("Z", 1, day(60), "x", "")], [("Z", 99, at(60), "mock", True, [], [], None)]  # moves both watermarks past all days
    for k, order in enumerate(itertools.permutations(["early", "credits", "late"])):
        parts = {"early": ([], [advice[0], advice[2], advice[4]]), "credits": (credits, []), "late": ([], [advice[1], advice[3], advice[5]])}
        if order.index("credits") == 1:
            parts["credits"], parts["late"] = (credits[:2], [advice[5]]), (credits[2:], [advice[1], advice[3]])
        steps = [parts[p] for p in order] + [far]
        folder = tmp_path / str(k)
        for i, step in enumerate(steps):  # a file a step and side, so that each is a batch of its own
            for name, some, kind in zip(("credits", "advice"), step, (CREDITS, ADVICE), strict=True):
                spark.createDataFrame(some, kind).coalesce(1).write.mode("append").json(str(folder / name / f"p={i}"))
        got: list = []
        streams = [spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).json(str(folder / name / "p=*")) for name, kind in (("credits", CREDITS), ("advice", ADVICE))]
        query = late.start(*streams, lambda: (items, names, aliases), lambda out, _: got.extend(shape(out)), str(folder / "state"), DEFAULT, False)
        for _ in range(240):
            if not query.isActive:
                break
            time.sleep(0.5)
        assert query.exception() is None and not query.isActive
        assert sorted(g for g in got if g[0] != "Z") == want, order
        if k == 1:
            break
