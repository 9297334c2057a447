"""Property tests (hypothesis): contract validation against a plain model,
order-independent dedup, exempt masking is the identity."""


from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import write_json
from lakeloom.config import EVENTS
from lakeloom.functions.contract import MISSING_PREFIX
from lakeloom.operators import commit as C
from lakeloom.operators.dedup import latest_by_key
from lakeloom.plans.ingest import ingest
from lakeloom.sources.landing import ScanScope

SPEC = EVENTS["page_views"]
REQ = SPEC.required
SETTINGS = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))

value = st.one_of(st.none(), st.just(""), st.just(" "), st.just(0), st.just(False),
                  st.text(alphabet="abc123", min_size=1, max_size=4), st.integers(-5, 5))
record = st.dictionaries(st.sampled_from(REQ + ("page_name",)), value, max_size=5)


def expected_reason(rec):
    missing = [k for k in REQ if rec.get(k) is None or rec.get(k) == ""]
    return MISSING_PREFIX + ", ".join(missing) if missing else None


@SETTINGS
@given(st.lists(record, min_size=1, max_size=12))
def test_contract_matches_plain_model(spark, tmp_root_factory, records):
    root = tmp_root_factory()
    for r in records:  # a valid timestamp text keeps this about missing keys only
        if isinstance(r.get("event_timestamp"), (str, int)) and r.get("event_timestamp") not in ("",):
            r["event_timestamp"] = "2026-05-01T00:00:00Z"
    write_json(f"{root}/landing/dt=2026-05-01/hr=00/f.json", records)
    ingest(spark, SPEC, f"{root}/landing", f"{root}/wh", ScanScope.backfill())
    got = {r._pos: r._reason for r in C.committed(spark, f"{root}/wh", C.RAW).collect()}
    assert got == {i: expected_reason(r) for i, r in enumerate(records)}


@SETTINGS
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=40, unique_by=lambda t: t),
       st.integers(0, 1000))
def test_dedup_order_independent(spark, tmp_root_factory, rows, seed):
    df = spark.createDataFrame(rows, "k int, o int")
    a = sorted(latest_by_key(df, ["k"], ["o"]).collect())
    b = sorted(latest_by_key(df.orderBy(F.rand(seed)).repartition(4), ["k"], ["o"]).collect())
    expect = sorted({k: max(o for kk, o in rows if kk == k) for k, _ in rows}.items())
    assert a == b and [(r.k, r.o) for r in a] == expect


@SETTINGS
@given(st.lists(st.one_of(st.none(), st.decimals(min_value=-10**6, max_value=10**6, places=2,
                                                 allow_nan=False, allow_infinity=False)),
                min_size=1, max_size=20),
       st.sampled_from(["REVOPS_ADMIN", "SYSADMIN", "FINANCE_ANALYST", "REVOPS_DEVELOPER"]))
def test_exempt_read_is_identity(spark, tmp_root_factory, values, role):
    from lakeloom.operators.governance import masked
    from lakeloom.sources.settings import Governance
    gov = Governance.load(spark)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, arr decimal(18,2)")
    out = masked(spark, df, "SALESFORCE_RAW_FIVETRAN.ACCOUNT", role, gov)
    assert sorted(out.collect()) == sorted(df.collect())
    hidden = masked(spark, df, "SALESFORCE_RAW_FIVETRAN.ACCOUNT", "REVOPS_READER", gov)
    assert [r.arr for r in hidden.collect()] == [None] * len(values)
