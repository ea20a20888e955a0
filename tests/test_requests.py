"""The request language: parsing, checks, and filters through relations against plain Python."""

import pytest
from pyspark.sql import functions as F

from reefline.operators.requests import Catalogue, Collection, Link, commas, parsed


def test_query_strings():
    text = "?filters[a][b][$eq]=x%20y&filters[$or][0][c]=1&filters[$or][1][c]=2&fields[0]=a&fields[1]=b&sort=a:asc&populate[r][populate][q][fields]=*&pagination[page]=2"
    assert parsed(text) == {
        "filters": {"a": {"b": {"$eq": "x y"}}, "$or": [{"c": "1"}, {"c": "2"}]}, "fields": ["a", "b"], "sort": "a:asc", "populate": {"r": {"populate": {"q": {"fields": "*"}}}}, "pagination": {"page": "2"},
    }
    assert parsed("") == {} and parsed("populate=*") == {"populate": "*"}
    assert commas({"fields": "a, b", "sort": "a", "locale": "x,y"}) == {"fields": ["a", "b"], "sort": "a", "locale": "x,y"}


@pytest.fixture(scope="module")
def books(spark):
    authors = spark.createDataFrame([(1, "Ann", None), (2, "Bob", 1), (3, "Cy", 1), (4, None, None)], "id long, name string, teacher long")
    titles = spark.createDataFrame([(10, "x", 1, 5.0), (11, "y", 1, 3.0), (12, "z", 2, None), (13, "x", None, 4.0), (14, "w", 1, 3.0)], "id long, title string, author long, price double")
    tags = spark.createDataFrame([(10, "a"), (10, "b"), (11, "b"), (13, "b"), (13, "b"), (99, "a"), (12, None)], "book long, tag string")
    words = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("c", None)], "slug string, label string")
    names = spark.createDataFrame([("a", "en", "Alpha!"), ("a", "fr", "Alphe"), ("b", "fr", None), ("b", "en", "Beta!"), ("c", "de", "Zeh")], "document string, locale string, label string")
    return Catalogue({
        "authors": Collection(authors, "id", ["id", "name"], {"books": Link("books", "id", "author", True), "teacher": Link("authors", "teacher", "id"), "pupils": Link("authors", "id", "teacher", True)}),
        "books": Collection(titles, "id", ["id", "title", "price"], {"author": Link("authors", "author", "id"), "tags": Link("tags", "id", "slug", True, (tags, "book", "tag"))}),
        "tags": Collection(words, "slug", ["slug", "label"], names=names),
    })


def ids(books, name, request, **options):
    return [r[0] for r in books.read(name, request, **options)[0].collect()]


@pytest.mark.parametrize(("spec", "want"), [
    ({"author": {"name": "Ann"}}, [10, 11, 14]),
    ({"tags": {"slug": {"$in": ["a", "b"]}}}, [10, 11, 13]),
    ({"tags": {"slug": "a"}, "author": {"name": {"$eq": "Ann"}}}, [10]),
    ({"$not": {"tags": {"slug": "b"}}}, [12, 14]),
    ({"$not": {"author": {"name": "Ann"}}}, [12, 13]),
    ({"$or": [{"price": {"$lt": 4}}, {"author": {"teacher": {"name": "Ann"}}}]}, [11, 12, 14]),
    ({"$and": [{"tags": {"slug": "a"}}, {"tags": {"slug": "b"}}]}, [10]),
    ({"price": {"$null": True}}, [12]),
    ({"tags": {"label": "Beta!"}}, [10, 11, 13]),
    ({}, [10, 11, 12, 13, 14]),
])
def test_filters(books, spec, want):
    data, meta = books.read("books", {"filters": spec})
    assert [r.id for r in data.collect()] == want
    assert meta.first().total == len(want)


def test_sort_and_pages(books):
    assert ids(books, "books", {"sort": "price:desc"}) == [10, 13, 11, 14, 12]
    assert ids(books, "books", {"sort": ["author.name:desc", "price"]}) == [12, 11, 14, 10, 13]
    assert ids(books, "books", "sort=price:asc&pagination[page]=2&pagination[pageSize]=2") == [13, 10]
    assert ids(books, "books", "pagination[start]=1&pagination[limit]=3") == [11, 12, 13]
    assert ids(books, "books", {"sort": "title,id:desc", "fields": "id,title"}, v4=True) == [14, 13, 10, 11, 12]
    data, meta = books.read("books", {"pagination": {"pageSize": 2}})
    assert data.count() == 2 and tuple(meta.first()) == (1, 2, 3, 5)


def test_relations(books):
    data, _ = books.read("authors", {"populate": {"books": {"fields": ["title"], "sort": "price:desc,title", "filters": {"price": {"$notNull": True}}, "populate": {"tags": {"fields": ["label"]}}}, "pupils": {"fields": ["name"]}, "teacher": True}, "locale": "fr"})
    rows = {r.id: r for r in data.collect()}
    assert [(b.id, b.title, [t.label for t in b.tags]) for b in rows[1].books] == [(10, "x", ["Alphe", "Beta!"]), (14, "w", []), (11, "y", ["Beta!"])]
    assert rows[2].books == [] and rows[4].books == [] and [p.name for p in rows[1].pupils] == ["Bob", "Cy"]
    assert rows[2].teacher.name == "Ann" and rows[1].teacher is None
    star = books.read("books", {"populate": "*", "fields": ["title"]})[0]
    assert star.columns == ["id", "title", "author", "tags"]
    deep = books.read("books", {"populate": ["author.teacher", "tags"]})[0].where("id = 12").first()
    assert deep.author.teacher.name == "Ann"


def test_one_record(books):
    assert books.find("books", 13, {"fields": ["title"], "populate": "author"}).first().asDict() == {"id": 13, "title": "x", "author": None}
    assert books.find("books", 77).count() == 0


@pytest.mark.parametrize("request_", [
    {"fields": ["author"]}, {"filters": {"nothing": 1}}, {"filters": {"title": {"$regex": "x"}}}, {"populate": ["publisher"]}, {"sort": "tags.slug"}, {"sort": "nothing"}, {"pagination": {"page": 0}}, {"populate": {"author": {"fields": ["teacher"]}}},
])
def test_what_isnt_there_is_an_error(books, request_):
    with pytest.raises(ValueError):
        books.read("books", request_)


def test_unknown_collections(books):
    with pytest.raises(ValueError, match="collection"):
        books.read("nothing")


def test_the_page_is_cut_before_relations_are_read(books):
    """Relations are joined to the rows of the page: the limit stands below the joins."""
    plan = books.read("authors", {"populate": {"books": {"fields": ["title"]}}, "pagination": {"pageSize": 2}})[0]
    assert plan.count() == 2 and plan.select(F.size("books")).agg(F.sum("size(books)")).first()[0] == 4
