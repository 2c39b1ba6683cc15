import random

import pytest
from pyspark.sql import functions as F

from lurescope.functions import url_basic, url_enriched
from lurescope.functions.urls import extract_urls, split_url

#: Worked out by hand from the feature definitions.
ENRICHED = {
    "http://www.paypal-login.com/verify": {
        "hyphen_count_domain": 1, "subdomain_depth": 0, "path_depth": 1, "suspicious_keyword_count": 2,
        "has_suspicious_keyword": 1, "num_dots": 2, "has_https": 0, "domain_to_url_len_ratio": 16 / 34,
        "consonant_run_max": 2, "char_class_transitions": 4, "char_class_transition_ratio": 0.25,
        "vowel_ratio": 7 / 27, "digit_ratio_domain": 0, "brand_in_path_not_domain": 0,
    },
    "https://u:p@1.2.3.4:8080/a//b?x=%20%41": {
        "is_ip_host": 0, "has_port": 1, "has_at_symbol": 1, "percent_encoding_count": 2,
        "percent_encoding_ratio": 2 / 38, "path_depth": 3, "has_https": 1, "num_dots": 3,
        "digit_run_max": 4, "domain_entropy": 0, "domain_to_url_len_ratio": 1 / 38,
    },
    "192.168.1.1/login": {
        "is_ip_host": 1, "subdomain_depth": 2, "digit_ratio_domain": 8 / 11, "path_depth": 1,
        "suspicious_keyword_count": 1, "char_class_transitions": 6, "digit_run_max": 3,
        "has_https": 0, "domain_to_url_len_ratio": 11 / 17, "consonant_run_max": 0,
    },
    "http://bit.ly/xn--a": {"is_shortener": 1, "has_punycode": 0, "path_depth": 1},
    "http://xn--pypal-4ve.com/PayPal": {"has_punycode": 1, "brand_in_path_not_domain": 1, "hyphen_count_domain": 3},
    "aabb": {"url_entropy": 1, "domain_entropy": 1, "vowel_ratio": 0.5, "path_depth": 0},
    "http://[bad/x": {"domain_entropy": 0, "path_depth": 0, "has_https": 0, "domain_to_url_len_ratio": 0},
    "": dict.fromkeys(url_enriched.FEATURES, 0),
}
BASIC = {
    "https://www.ex.com/a=1&b?c/": {
        "URLLength": 26, "DomainLength": 10, "TLDLength": 3, "NoOfSubDomain": 1, "IsDomainIP": 0,
        "NoOfLettersInURL": 8, "LetterRatioInURL": 8 / 26, "NoOfDegitsInURL": 1, "DegitRatioInURL": 1 / 26,
        "NoOfEqualsInURL": 1, "NoOfQMarkInURL": 1, "NoOfAmpersandInURL": 1, "NoOfOtherSpecialCharsInURL": 2,
        "SpacialCharRatioInURL": 5 / 26, "HasObfuscation": 0, "IsHTTPS": 1,
    },
    " HTTP://User@1.2.3.4:80/%41é!": {
        "URLLength": 28, "DomainLength": 7, "IsDomainIP": 1, "NoOfObfuscatedChar": 2, "HasObfuscation": 1,
        "ObfuscationRatio": 2 / 28, "NoOfDegitsInURL": 8, "NoOfLettersInURL": 9, "IsHTTPS": 0,
    },
    "": dict.fromkeys(url_basic.FEATURES, 0),
}


def fuzz(n=600):
    rng = random.Random(7)
    alphabet = "abcXYZ019.-:/?#@[];%=& \t_éß²٣" + "\U0001F600"
    heads = ["", "http://", "https://", "www.", "HTTP://WWW.", "//", "http://[", "ftp://"]
    return [
        rng.choice(heads) + "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 24)))
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    "expected,compute", [(ENRICHED, url_enriched.with_enriched_features), (BASIC, url_basic.with_basic_features)]
)
def test_features_of_known_urls(spark, expected, compute):
    frame = spark.createDataFrame([(u,) for u in expected], "url string")
    for row in compute(frame, "url").collect():
        want = expected[row["url"]]
        assert {n: row[n] for n in want} == pytest.approx(want), row["url"]


def test_enriched_properties(spark):
    data = list(dict.fromkeys(fuzz()))
    out = url_enriched.with_enriched_features(spark.createDataFrame(list(enumerate(data)), "id long, url string"), "url")
    assert out.columns == ["id", "url", *url_enriched.FEATURES]
    ratios = [n for n in url_enriched.FEATURES if "ratio" in n] + [
        n for n in url_enriched.FEATURES if n.startswith(("is_", "has_")) or n == "brand_in_path_not_domain"
    ]
    for row in out.collect():
        url = data[row["id"]]
        assert all(0 <= row[n] <= 1 for n in ratios), url
        assert row["num_dots"] == url.count(".") and row["percent_encoding_count"] == url.count("%")
        assert row["has_at_symbol"] == ("@" in url)
        assert row["has_suspicious_keyword"] == (row["suspicious_keyword_count"] > 0)
        assert 0 <= row["url_entropy"] <= 5 and row["domain_entropy"] >= 0
        assert row["has_https"] <= url.lower().strip().startswith(("https:", "\x00", "h"))


def test_one_more_slash_is_one_more_level(spark):
    bases = ["http://a.example", "https://b.example/x", "c.example/y/z", "http://d.example/p//q"]
    frame = spark.createDataFrame([(i, u + "/" * k, k) for i, u in enumerate(bases) for k in (0, 1, 2)], "i int, url string, k int")
    rows = {(r["i"], r["k"]): r["path_depth"] for r in url_enriched.with_enriched_features(frame, "url").collect()}
    for i in range(len(bases)):
        assert rows[i, 1] - rows[i, 0] == 1 and rows[i, 2] - rows[i, 1] == 1


def test_basic_properties(spark):
    data = list(dict.fromkeys(fuzz()))
    out = url_basic.with_basic_features(spark.createDataFrame(list(enumerate(data)), "id long, url string"), "url")
    for row in out.collect():
        url = data[row["id"]]
        assert row["URLLength"] == max(len(url) - 1, 0)
        assert all(0 <= row[n] <= 1 for n in url_basic.FEATURES if "Ratio" in n or n.startswith(("Is", "Has"))), url
        parts = row["NoOfEqualsInURL"] + row["NoOfQMarkInURL"] + row["NoOfAmpersandInURL"]
        assert row["NoOfOtherSpecialCharsInURL"] >= 0 and parts >= 0
        assert row["TLDLength"] <= row["DomainLength"]


def test_split_hosts(spark):
    cases = {
        "http://[::1]:80/x": ("[::1]:80", True),
        "http://[bad/x": ("[bad", False),
        "foo bar://x/y": ("", True),
        "http:///p": ("", True),
        "1http://x": ("", True),
    }
    frame = spark.createDataFrame([(u,) for u in cases], "url string")
    for row in split_url(frame, F.col("url"), "p_").collect():
        assert (row["p_netloc"], row["p_ok"]) == cases[row["url"]]


def test_excluded_feature_is_dropped(spark):
    frame = spark.createDataFrame([("http://a.example",)], "url string")
    out = url_enriched.with_enriched_features(frame, "url", exclude=["has_https"])
    assert "has_https" not in out.columns and len(out.columns) == 24
    with pytest.raises(ValueError):
        url_enriched.feature_names(["nope"])


def test_extract_urls(spark):
    body = "see http://a.example/x, (www.b.example) <https://c.example?q='1'> www.\u00a0d 'http://e'"
    frame = spark.createDataFrame([(body,), (None,), ("none here",)], "body string")
    got = [r[0] for r in frame.select(extract_urls(F.col("body"))).collect()]
    assert got == [
        ["http://a.example/x,", "www.b.example)", "https://c.example?q=", "http://e"], [], []
    ]
