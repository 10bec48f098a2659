"""Interface answers that cannot be read."""

from sitewarden.operators import responses

SCHEMA = "target_id bigint, path string, status int, content_type string, body string, module string"


def test_every_body_is_read_or_set_aside(spark):
    json = "application/json; charset=utf-8"
    rows = [
        (1, "/swagger.json", 200, json, '{"swagger": "2.0"}', "x"), (2, "/swagger.json", 200, json, "{oops", "x"),
        (2, "/swagger.json", 200, json, "{oops", "x"), (3, "/swagger.json", 200, json, "", "x"),
        (4, "/graphql", 200, None, "<html>", "x"), (5, "/graphql", 200, "text/html", '{"data": {}}', "x"),
        (6, "/graphql", 200, json, None, "x"), (7, "/graphql", 404, json, "no", "x"), (8, "/swagger.json", 200, None, "no", "x"),
        (9, "/swagger.json", 200, "text/html", "no", "x"), (10, None, None, None, None, None), (11, "/graphql", 200, json, "null", "x"),
    ]
    documents = responses.api_documents(spark.createDataFrame(rows, SCHEMA))
    bad = responses.unreadable_bodies(documents)
    assert sorted(tuple(r) for r in bad.collect()) == [
        (2, "openapi", "/swagger.json"), (2, "openapi", "/swagger.json"), (3, "openapi", "/swagger.json"), (4, "graphql", "/graphql"),
    ]
    assert documents.count() == bad.count() + documents.filter("document is not null").count() == 7
    assert responses.unreadable_bodies(responses.api_documents(spark.createDataFrame([], SCHEMA))).count() == 0
