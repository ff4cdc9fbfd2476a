import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidefold.fixtures.rates import demo_book  # noqa: E402
from tidefold.session import local_session  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def book(spark):
    return demo_book(spark)


def person(ssn="900000000017", dob="1994-03-08"):
    return {"id": "7000000000000000017", "ssn": ssn, "dob": dob, "gender": "Male",
            "relatsh": "Other"}


def policy(**changes):
    """An invented policy document; keyword arguments replace fields of the base cover."""
    base = {
        "id": "UVL01", "rcd": "2023-06-30", "paymode": "Quarterly", "channel": "CHNL002",
        "status": "Inforce", "insured": person(),
        "load": {"em_load": 0.5, "em_load_term": 12, "pm_load": 3, "pm_load_term": 9},
        "si": 120000000.0, "opted_tp_term": 28, "ep": 2400000.0, "opted_ep_term": 17,
        "death_tpd_option": "B", "maturity_option": 1, "acc_ben_coeff": 2,
        "fund_alloc": [{"fund": "F000", "tp_pct": 100, "ep_pct": 100}],
        "withdrawal_plan": [
            {"from": 6, "to": 8, "amount": 2000000.0},
            {"from": 14, "to": 15, "amount": 4000000.0},
        ],
    }
    base.update(changes)
    return {
        "id": "p-1",
        "owner": {"id": "7000000000000000001", "ssn": "900000000001", "dob": "1969-10-02"},
        "created_date": "2023-07-04", "base": base,
        "rider": [{"id": "WOP01", "rcd": "2023-06-30", "paymode": "Quarterly",
                   "channel": "CHNL002", "status": "Inforce",
                   "insured": person(dob="1996-12-12")}],
    }


def documents(spark, *docs):
    from tidefold.sources.policies import parse_policies

    texts = [(d if isinstance(d, str) else json.dumps(d),) for d in docs]
    return parse_policies(spark.createDataFrame(texts, "value string"))


def policies(spark, *docs):
    from tidefold.sources.policies import loadable

    return loadable(documents(spark, *docs))
