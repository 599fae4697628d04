import random

from pyspark.sql import functions as F

from folioflow.functions.amounts import amount_candidates, total_amount
from folioflow.functions.dates import date_candidates, invoice_date
from folioflow.functions.strings import from_first_cue

ODD_PIECES = (
    "Total", "SubTotal: $", "subtotal", "grand total ", "Amount Due", "date:", "Invoice Date ",
    "bill date", "updated:", " ", "\n", "\xa0", "€", "𝒳", "İ", "x", "abc", "Jan 5, 2020",
    "mar\xa031, 1999", "date 12, 2020", "1/2/2020", "31/12/99", "2020-02-30", "12345/1/2020",
    "1,234.50", "12345", "0.00", "7", ",", ".", "the quick brown fox jumps ",
)


def test_search_after_the_first_cue_equals_search_of_the_whole_text(spark):
    """The rest of a text from its first keyword on decides as the whole text does."""
    rng = random.Random(11)
    texts = ["", *("".join(rng.choices(ODD_PIECES, k=rng.randint(1, 14))) for _ in range(3000))]
    frame = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text STRING")
    rank = F.transform(
        date_candidates("text"),
        lambda c: F.struct((-c["score"]).alias("r"), c["position"], c["value"]),
    )
    first, cases = F.array_min(rank), []
    cases.append((invoice_date("text"), first["value"], F.coalesce(-first["r"], F.lit(0.0))))
    for plain in (False, True):
        for sub in (False, True):
            best = F.array_max(
                amount_candidates("text", plain_digits=plain, penalise_subtotal=sub))
            cases.append((total_amount("text", plain_digits=plain, penalise_subtotal=sub),
                          best["value"], F.coalesce(best["score"], F.lit(0.0))))
    for found, value, confidence in cases:
        wrong = frame.select("text", found.alias("f"), value.alias("v"), confidence.alias("c"))
        wrong = wrong.filter(
            ~F.col("f.value").eqNullSafe(F.col("v")) | (F.col("f.confidence") != F.col("c")))
        assert wrong.collect() == []
    assert from_first_cue("text", ("total",)) is not None
    assert from_first_cue("text", ("№ total",)) is None
