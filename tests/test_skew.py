"""Hot keys: one seller, one product and one customer each hold a third of
the rows. Broadcasts are off and AQE's skew-join split is forced even on
this small data. Results must equal a brute-force computation in plain
Python. The hot product reaches a join (items x products) and is split
there; the hot seller and hot customer never reach a join as raw rows,
because those queries aggregate first."""

from __future__ import annotations

from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest

from agora.operators import category, customer, seller
from agora.plans.inspect import plan_text
from tests.golden import item, order, tables

N_ORDERS = 300
SKEW_CONF = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
}


@pytest.fixture
def skew_session(spark):
    before = {k: spark.conf.get(k, None) for k in SKEW_CONF}
    for k, v in SKEW_CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        if v is None:
            spark.conf.unset(k)
        else:
            spark.conf.set(k, v)


def _data():
    customers = [(f"c{i}", f"u{i // 2}", "x", f"S{i % 5}") for i in range(60)] + [("chot", "uhot", "x", "SHOT")]
    orders, items, reviews = [], [], []
    for k in range(N_ORDERS):
        cust = "chot" if k % 3 == 0 else f"c{k % 60}"
        late = k % 7 == 0
        orders.append(order(f"o{k}", cust=cust, purchase=k % 90, delivered=12 if late else 5, estimated=10))
        for j in range(3):
            hot = j == 0  # a third of all items: hot seller and hot product
            items.append(
                item(
                    f"o{k}",
                    product="phot" if hot else f"p{(k + j) % 20}",
                    seller="shot" if hot else f"s{(k * j) % 15}",
                    price=f"{(k % 17) + j}.50",
                    freight="1.25",
                )
            )
        if k % 4:
            reviews.append((f"o{k}", 1 + k % 5, None, None))
    products = [("phot", "cat_a", 1.0)] + [(f"p{i}", f"cat_{'ab'[i % 2]}", 1.0) for i in range(20)]
    sellers = [("shot",)] + [(f"s{i}",) for i in range(15)]
    categories = [("cat_a", "a"), ("cat_b", "b")]
    return dict(orders=orders, items=items, reviews=reviews, products=products, sellers=sellers,
                category=categories, customers=customers)


def test_seller_metrics_with_hot_seller(skew_session):
    d = _data()
    t = tables(skew_session, **d)
    got = {r["seller_id"]: (r["order_volume"], r["late_pct"]) for r in seller.seller_metrics(t).collect()}
    late = {o[0]: o[6] > o[7] for o in d["orders"]}
    per = defaultdict(set)
    for it in d["items"]:
        per[it[2]].add(it[0])
    def pct(n, d):
        return float((Decimal(n * 100) / Decimal(d)).quantize(Decimal("0.1"), rounding=ROUND_HALF_UP))

    want = {s: (len(os_), pct(sum(late[o] for o in os_), len(os_))) for s, os_ in per.items()}
    assert got == want
    assert got["shot"][0] == N_ORDERS


def test_state_revenue_with_hot_customer(skew_session):
    d = _data()
    t = tables(skew_session, **d)
    got = {r["customer_state"]: r["total_revenue"] for r in customer.revenue_by_state(t).collect()}
    state = {c[0]: c[3] for c in d["customers"]}
    cust = {o[0]: o[1] for o in d["orders"]}
    want = defaultdict(Decimal)
    for it in d["items"]:
        want[state[cust[it[0]]]] += it[3] + it[4]
    assert got == {s: float(v) for s, v in want.items()}
    r = customer.repeat_customers(t).first()
    per_person = defaultdict(int)
    uid = {c[0]: c[1] for c in d["customers"]}
    for o in d["orders"]:
        per_person[uid[o[1]]] += 1
    assert r["total_unique_customers"] == len(per_person)


def test_category_volume_with_hot_product(skew_session):
    d = _data()
    t = tables(skew_session, **d)
    df = category.category_performance(t, min_orders=1)
    got = {r["category"]: (r["order_volume"], r["total_revenue"]) for r in df.collect()}
    assert "skew=true" in plan_text(df, "simple")  # the hot product's join was split
    cat = {p[0]: {"cat_a": "a", "cat_b": "b"}[p[1]] for p in d["products"]}
    orders_of, rev = defaultdict(set), defaultdict(Decimal)
    for it in d["items"]:
        orders_of[cat[it[1]]].add(it[0])
        rev[cat[it[1]]] += it[3] + it[4]
    assert got == {c: (len(orders_of[c]), float(rev[c])) for c in orders_of}
