from basaltiq.operators import logs

LINES = [
    "2024-01-05T10:00:00 host ERROR Failed to connect to 10.0.0.1 user=ann status 503 404",
    "2024-01-05T09:00:00 host ERROR Failed to connect to 10.0.0.1 user=ann status 503 404",
    "2024-01-06T09:00:00 host WARN Permission Denied User: bob é200",
    "  ",
    None,
    "INFO NOTICE out of memory fatal: 1234 10.0.0.12345",
]


def test_profile(spark):
    lines = spark.createDataFrame([("a", x, 1, 2) for x in LINES] + [("b", "plain", 1, 2), ("c", "", 1, 2)], "file string, line string, field int, n int")
    got = {tuple(r) for r in logs.profile(lines).collect()}
    assert got == {
        ("a", "lines", None, 4), ("a", "events", None, 3), ("a", "from", "2024-01-05T09:00:00", 3), ("a", "to", "2024-01-06T09:00:00", 3),
        ("a", "ip", "10.0.0.1", 2), ("a", "user", "ann", 2), ("a", "status", "503", 2), ("a", "status", "404", 2), ("a", "status", "200", 1),
        ("a", "level", "ERROR", 2), ("a", "level", "WARN", 1), ("a", "level", "INFO", 1),
        ("a", "fault:high", "Failed to connect", 2), ("a", "fault:high", "permission denied", 1), ("a", "fault:critical", "out of memory", 1), ("a", "fault:critical", "fatal:", 1),
        ("b", "lines", None, 1), ("b", "events", None, 1),
    }


def test_no_lines(spark):
    assert logs.profile(spark.createDataFrame([], "file string, line string")).count() == 0
