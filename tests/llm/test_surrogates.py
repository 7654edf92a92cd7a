import random
import re

from riskloom.llm import surrogates as S

TEXT = ("Mr. John Smith wrote to Frau Anna Müller, MARY JONES and Mr. Smith: a.b9@mail.example.com, A.B9@MAIL.EXAMPLE.COM "
        "+1 (017) 555-7713, card 4111 1111 1111 1111 or 4111111111111111; 97.51.17.173. DE89 3704 0044 0532 0130 00 ssn 123-45-6789 "
        "Госпожа Анна Петрова.")


def luhn(number):
    digits = [int(c) for c in reversed(number) if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(digits)) % 10 == 0


def test_form_and_coreference(spark):
    docs = spark.createDataFrame([(1, TEXT, "x"), (2, "again 97.51.17.173 and +1 017 555 7713", "y")], "doc_id long, text string, found string")
    out = {r["doc_id"]: r for r in S.replaced(docs).collect()}
    text = out[1]["text"]
    for old in ("John", "Smith", "Anna", "Müller", "MARY", "JONES", "a.b9", "017", "4111", "97.51", "3704", "123-45", "Анна", "Петрова"):
        assert old not in text
    m = re.fullmatch(
        r"Mr\. (\w+) (\w+) wrote to Frau (\w+) (\w+), ([A-Z]+) ([A-Z]+) and Mr\. (\w+): (\S+\.\S+\.example), (\S+\.EXAMPLE) (\+1 \(\d{3}\) \d{3}-\d{4}), "
        r"card (\d{4} \d{4} \d{4} \d{4}) or (\d{16}); (10\.\d+\.\d+\.\d+)\. (DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) ssn (\d{3}-\d\d-\d{4}) "
        r"Госпожа ([А-Я][а-я]+) ([А-Я][а-я]+)\.", text)
    assert m and m[2] == m[7] and m[8].upper() == m[9]
    assert m[1].endswith("rik") and m[3].endswith("lina") and m[5].endswith("LINA") and m[16].endswith("лина")
    assert m[11].replace(" ", "") == m[12] and luhn(m[12])
    digits = re.sub(r"\D", "", m[10])
    assert out[2]["text"] == f"again {m[13]} and +1 {digits[1:4]} {digits[4:7]} {digits[7:]}"
    assert (out[1]["n_entities"], out[2]["n_entities"], out[1]["found"]) == (13, 2, "x")


def valid_account(number):
    turned = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def test_later_mentions_particles_and_scripts(spark):
    rows = [
        (1, "John Smith called. Smith said that Anna would come. SMITH's car, John. Smithson and Blacksmith stay; smith too."),
        (2, "Peter van der Berg and Olga Novak met Mr. van der Berg. Berg left, Novak’s aunt stayed."),
        (3, "我们请王伟先生发言。王伟说李女士来了。"), (4, "Dr. Kim and Frau Kim Lee: Lee"), (5, "James Thomas came. Thomas went."),
        (6, "DE89370400440532013000 GB82 WEST 1234 5698 7654 32 DE00370400440532013000"),
    ]
    out = {r["doc_id"]: r["text"] for r in S.replaced(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    m = re.fullmatch(r"(\w+) (\w+) called\. (\w+) said that (\w+) would come\. (\w+)'s car, (\w+)\. Smithson and Blacksmith stay; smith too\.", out[1])
    assert m and m[2] == m[3] == m[5].capitalize() and m[1] == m[6] and m[1].endswith("rik") and m[4].endswith("lina") and m[5].isupper()
    n = re.fullmatch(r"(\w+) van der (\w+) and (\w+) (\w+) met Mr\. van der (\w+)\. (\w+) left, (\w+)’s aunt stayed\.", out[2])
    assert n and n[2] == n[5] == n[6] and n[4] == n[7] and n[3].endswith("lina")
    h = re.fullmatch(r"我们请(\w{3,})先生发言。(\w+)说(\w{3,})女士来了。", out[3])
    assert h and h[1] == h[2] != h[3] and "王伟" not in out[3] and h[1][0] in S.HAN_SURNAMES
    k = re.fullmatch(r"Dr\. (\w+) and Frau (\w+) (\w+): (\w+)", out[4])
    assert k and k[1] == k[2] != "Kim" and k[3] == k[4] != "Lee"
    t = re.fullmatch(r"(\w+) (\w+) came\. (\w+) went\.", out[5])
    assert t and t[2] == t[3] != "Thomas"
    a, b, c = re.fullmatch(r"(DE\d{20}) (GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d) (DE\d{20})", out[6]).groups()
    assert valid_account(a) and valid_account(b.replace(" ", "")) and a[4:] != "370400440532013000" and c != a


def test_against_known_pieces(spark):
    """Texts put together from plain words and known entities: plain words stay, entities map one to one."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    pool = [f"{w}{rng.randint(1, 99)}@h{i}.example.org" for i, w in enumerate("abcdefgh")] + [f"{digits(3)}-{digits(2)}-{digits(4)}" for _ in range(8)]
    pool += [f"192.0.{i}.{i + 3}" for i in range(8)] + [f"+1 {digits(3)} {digits(3)} {digits(4)}" for _ in range(8)]
    people = [f"{g} {f}" for g, f in zip(("Mary", "Paul", "Olga", "Иван"), ("Brown", "O'Neil", "Novák-Berg", "Попов"))]
    rows, made = [], {}
    for i in range(60):
        pieces = []
        for _ in range(rng.randint(0, 8)):
            pieces += [rng.choice(["so", "and then,", "при", "ünd;"]), rng.choice(pool + people)]
        rows.append((i, " ".join([*pieces, "end"]), pieces))
    out = {r["doc_id"]: r for r in S.replaced(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    for i, _, pieces in rows:
        assert out[i]["n_entities"] == len(pieces) // 2
        form = " ".join("(.+)" if at % 2 else re.escape(p) for at, p in enumerate([*pieces, "end"]))
        for old, new in zip(pieces[1::2], re.fullmatch(form, out[i]["text"]).groups()):
            assert made.setdefault(old, new) == new and len(new.split(" ")) == len(old.split(" "))
    assert len(set(made.values())) == len(made) == len(pool) + len(people) and not set(made) & set(made.values())


def test_key_decides(spark):
    docs = spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string")
    one, same, other = (S.replaced(docs, k).collect()[0]["text"] for k in ("k", "k", "l"))
    assert one == same != other


def test_collisions_are_resolved(spark):
    """Far more card-like numbers of four free digits than chance keeps apart."""
    rows = [(f"ssn|{i:09d}",) for i in range(0, 1000)] + [(f"phone|1{i:02d}",) for i in range(100)] + [(f"surname|n{i}",) for i in range(500)]
    entities = spark.createDataFrame(rows, "entity string")
    out = S.surrogates(entities, "k").collect()
    assert len(out) == len(rows)
    made = [(r["entity"].split("|")[0], r["surrogate"]) for r in out]
    assert len(set(made)) == len(made)
    real = {tuple(r[0].split("|")) for r in rows}
    assert not [x for x in made if x in real]


def test_awkward_rows(awkward, nothing):
    out = S.replaced(awkward)
    assert set(out.columns) == {*awkward.columns, "n_entities"} and len(out.columns) == len(awkward.columns) + 1
    key = lambda r: tuple(str(r[c]) for c in awkward.columns)
    assert sorted(map(key, out.collect())) == sorted(map(key, awkward.collect()))
    assert S.replaced(nothing).count() == 0
