import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from siftwork.session import build_session  # noqa: E402

AS_OF = "2025-01-31 00:00:00"
DATA = os.environ.get("SIFTWORK_TESTDATA", "/root/testdata/sf0.001")

PROFILE = (
    "profile string, name string, bio string, job_type string, resume string, role_family string, titles array<string>, "
    "desired_skills array<string>, hard_no_keywords array<string>, remote_ok boolean, preferred_locations array<string>, "
    "min_yoe int, max_yoe int, max_job_age_days int, require_degree_filter boolean, title_blocklist array<string>, "
    "yoe double, min_salary bigint, monthly_stipend bigint, intern_pay_preference string, industries array<string>, "
    "education array<string>, nice_to_haves array<string>"
)


@pytest.fixture(scope="session")
def spark():
    session = build_session("siftwork-tests", 4, **{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def profile_rows(spark):
    """Build profile rows from keyword overrides of one engineer profile."""

    def build(*overrides):
        base = dict(
            profile="p", name="Sam", bio="", job_type="fulltime", resume="", role_family=None,
            titles=["Software Engineer", "Backend Developer"], desired_skills=["python", "docker"],
            hard_no_keywords=["unpaid"], remote_ok=True, preferred_locations=["Austin, TX"], min_yoe=0, max_yoe=5,
            max_job_age_days=30, require_degree_filter=False, title_blocklist=["staff", "senior", "sales development"],
            yoe=3.0, min_salary=None, monthly_stipend=None, intern_pay_preference=None, industries=[], education=[],
            nice_to_haves=[],
        )
        names = [f.split()[0] for f in PROFILE.split(", ")]
        rows = [{**base, **o} for o in (overrides or ({},))]
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PROFILE)

    return build
