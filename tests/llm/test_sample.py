from clinspark.llm.text import bounded_sample


def test_bounded_sample_does_not_depend_on_partitions(llm):
    drawn = [
        sorted(r["id"] for r in bounded_sample(llm.range(start, 9000, step, n), "id", most).collect())
        for most in (10, 1000) for start, step, n in ((0, 1, 1), (0, 1, 7))
    ]
    assert drawn[0] == drawn[1] and drawn[2] == drawn[3]
    assert (len(drawn[0]), len(drawn[2])) == (10, 1000) and set(drawn[0]) < set(drawn[2])
