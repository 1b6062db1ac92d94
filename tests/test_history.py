from clickweave.operators import history

D = (
    "id long, deploy_time long, environment string, commit_sha string, total_visitors long, bounce_rate double, "
    "avg_time_spent_seconds double, conversion_rate double"
)


def rows(*specs):
    return [(i, t, env, f"c{i}", v, b, 10.0, c) for i, t, env, v, b, c in specs]


def test_current_and_previous(table):
    d = table(D, *rows(
        (1, 100, "production", 10, 50.0, None), (2, 100, "production", 20, 60.0, 1.0), (3, 50, "production", 30, 0.0, 2.0),
        (4, 200, "preview", 99, 1.0, 1.0), (5, 40, "production", None, 10.0, None),
    ))
    assert [r.id for r in history.current_deployment(d).collect()] == [2]
    # 1 shares its time with the current one and is left out.
    assert [r.id for r in history.previous_deployments(d).collect()] == [3, 5]
    assert [r.id for r in history.previous_deployments(d, k=1).collect()] == [3]
    view = {r.deploymentId: r for r in history.history_view(d).collect()}
    assert view[2].role == "current" and view[3].role == "previous"
    assert view[2].deploymentDate == "1970-01-01T00:01:40.000Z"
    assert tuple(view[3].performanceScore) == (0, 0, 0, 0, 0)
    changes = {r.metric: r for r in history.change_vs_previous_mean(d).collect()}
    # A missing value counts as 0 in the mean of two.
    assert changes["total_visitors"].previous_mean == 15.0
    assert (changes["total_visitors"].change, changes["total_visitors"].direction, changes["total_visitors"].tone) == (33.3, "up", "good")
    assert (changes["bounce_rate"].change, changes["bounce_rate"].direction, changes["bounce_rate"].tone) == (1100.0, "up", "bad")
    assert (changes["avg_time_spent_seconds"].change, changes["avg_time_spent_seconds"].tone) == (0.0, "good")
    labels = {r.deploymentId: r for r in history.history_labels(history.history_view(d)).collect()}
    assert (labels[3].bounce, labels[3].avg_time, labels[3].conversion) == ("0.0%", "10s", "2.0%")
    assert labels[5].conversion == "0%"


def test_no_previous_mean_means_no_change(table):
    d = table(D, *rows((1, 100, "production", 10, 50.0, None)))
    got = history.change_vs_previous_mean(d).collect()
    assert {r.previous_mean for r in got} == {0.0}
    assert {(r.change, r.direction, r.tone) for r in got} == {(None, None, None)}
    assert history.previous_deployments(d, "preview").count() == 0


def test_deltas(table, both_ways):
    d = table(D, *rows(
        (1, 100, "production", 10, 50.0, 1.0), (2, 100, "production", 25, 40.0, None),
        (3, 10**8, "production", 5, 0.0, 2.0), (4, 7, "preview", 1, 1.0, 1.0),
    ))
    got = {r.id: (r.visitors_change, r.bounce_rate_change, r.conversion_change) for r in history.deployment_deltas(d, ["environment"]).collect()}
    assert got == {2: (15, -10.0, -1.0), 3: (-20, -40.0, 2.0)}
    last = history.deployment_deltas(history.last_deployments(d, 2)).collect()
    assert [(r.id, r.visitors_change) for r in last] == [(3, -20)]
