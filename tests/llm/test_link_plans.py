"""What linking asks of the driver, which doesn't shrink with the rows, and names of entities."""

from __future__ import annotations

from repolith.llm import link

#: Nearly all are a stage with its exchange; they were 135 when they filled the driver.
MOST_JOBS = 115

PEOPLE = [
    (1, "Jennifer Vedruhunz", "jennifer-vedruhunz@acme.example"),
    (2, "Jennifer Vsdruhunz", "vedruhunzj@post.example"),
    (3, "Vedruhunz Jennifer", None),
    (4, "Robert Stesibrinz", None),
    (5, "Stesibrinz, Robert", None),
    (6, None, None),
    (7, "", "nobody"),
    (8, "Theodore Marvesh", "thplegitras23@acme.example"),
    (8, "Theodore Marvesh", "thplegitras23@localhost"),
]


def test_jobs_and_entities(spark):
    df = spark.createDataFrame(PEOPLE, "node long, name string, mail string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.sparkContext.setJobGroup("link", "link")
    try:
        got = {r["node"]: r["entity"] for r in link.link(df, "node", "name", "mail").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("link"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got[1] == got[2] == got[3] == "h|jennifervedruhunz|jennifer vedruhunz"
    assert got[4] == got[5] == "i|4" and got[6] == "i|6" and got[7] == "i|7"
    assert got[8] == "h|thplegitras23|marvesh theodore" and len(got) == 8
    assert jobs <= MOST_JOBS, jobs
