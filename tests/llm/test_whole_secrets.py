"""Many literals of a name, and long names."""

import time

import pytest

from driftlake.llm import secret_scan


def test_literals_beyond_64_and_long_names():
    lines = "\n".join(f'part = part + "Zq{i:03d}xW9vKt7Lm"' for i in range(200))
    text = f'part = ""\n{lines}\ndb_password = part\n'
    assert len(secret_scan.literal_spans(text)) == 200
    name = "password_" + "of_some_generated_code" * 6
    for line in (f'{name} = "Zq81xW9vKt7Lm"', f'"{name}": "Zq81xW9vKt7Lm"', f"--{name}=Zq81xW9vKt7Lm"):
        assert [line[a:b] for a, _, b in secret_scan.literal_spans(line)] == ["Zq81xW9vKt7Lm"]
    assert secret_scan.literal_spans("a = 1\n" + "x" * 300_000) == []
    assert secret_scan.literal_spans("\n".join(["a = b + a + a"] * 3000) + "\npassword = a") == []


def found(text):
    return [text[a:b] for a, _, b in secret_scan.literal_spans(text)]


KEY = "Zq81xW9vKt7Lm"


@pytest.mark.parametrize(
    "text",
    [
        f'password = "{KEY}"', f"password='{KEY}'", f"password: {KEY}", f'{{"db": {{"password": "{KEY}", "port": 12}}}}', f"export DB_PASSWORD={KEY}",
        f"[db]\nuser = x\npassword = {KEY}\n", f"<db><password>{KEY}</password></db>", f'<db password="{KEY}"/>', f'<add key="password" value="{KEY}"/>',
        f'- name: DB_PASSWORD\n  value: {KEY}\n', f'os.environ["PASSWORD"] = "{KEY}"', f'connect(user="me", password="{KEY}", port=1)',
        f'password: str = "{KEY}"', f'password = os.getenv("X") or "{KEY}"', f'password = (\n  "{KEY}"\n)', f'password = b"{KEY}"', f'let password = `{KEY}`;',
        f'password = """{KEY}"""', f"db.password := '{KEY}'", f"'password' => '{KEY}',", f"don't use this: password = '{KEY}'", f"setup(password=load)\nload = '{KEY}'\n",
        f'BASE="{KEY}"\nPASSWORD=${{BASE}}\n', f'BASE="{KEY}"\nPASSWORD="pre-${{BASE}}"\n', f'a = "{KEY}"\nb = a\nc = b\npassword = c', f'password = c\nc = b\nb = a\na = "{KEY}"',
    ],
)
def test_syntaxes(text):
    assert KEY in found(text)


def test_escapes_blocks_and_what_is_none():
    assert found('password = "Zx9\\"Kq77+mP"') == ['Zx9\\"Kq77+mP']
    block = "secrets:\n  password: |\n    Zq81xW9v\n    Kt7LmAb3\n  user: someone99x\n"
    assert found(block) == ["Zq81xW9v\n    Kt7LmAb3"]
    assert found('password = "changeme"\nname = "Zq81xW9vKt7Lm"\ntoken = ""\nif password == "Zq81xW9vKt7Lm": pass') == []
    assert found("the key: see http://example.com/Zq81xW9vKt7Lm for passwords") == []
    # a later value of a name does not reach what was set before
    assert found('a = "Zq81xW9vKt7Lm"\npassword = a\na = "notforthis1234"') == [KEY]


def test_odd_texts_end_quickly():
    for text in ("password = " + "(" * 20_000, 'password = "' + "x" * 300_000, "password: |\n" + " \n" * 50_000, 'key="' * 20_000, "password " * 50_000 + "= a", "'" * 50_001 + "key=", '"""' + "key=a+" * 30_000):
        secret_scan.all_spans(text)


def test_nested_and_chained_statements_take_time_in_proportion():
    """A megabyte of each form within seconds (below 5 on a free box); in squares of its length it would take hours."""
    n = 1_000_000
    forms = {
        "nested": "token " + "a:(" * (n // 3), "later": "".join(f"token_{i} = y\n" for i in range(n // 32)) + "".join(f'y = "Zq{i}xW"\n' for i in range(n // 30)), "operands": "token:b1+" * (n // 9),
        "groups": "token:(x9)+" * (n // 11), "placeholders": "token:your1" * (n // 11), "names": "token = (" + "a = b + " * (n // 8), "strings": 'token:"a1b2c3"+' * (n // 15),
        "closed": "token:(" * (n // 14) + ")" * (n // 14), "calls": "a:b(" * (n // 4), "blocks": "".join(" " * i + f"token{i}: |\n" for i in range(1400)), "hills": "".join(" " * i + f"token{i}: |\n" for i in [*range(1000), *range(999, 0, -1)]), "lines": "token: (a + b +\n" * (n // 16),
    }
    for name, text in forms.items():
        began = time.process_time()
        secret_scan.all_spans(text)
        assert time.process_time() - began < 12, name


def test_nested_values_share_what_they_hold():
    assert found(f'outer = (1, password = (x, "{KEY}"), 2)') == [KEY]
    assert found(f'token = ("short" + (user + "{KEY}"))') == [KEY]
    assert found(f'a = b + "{KEY}"\ntoken = token + a') == [KEY]
    assert found(f'token = ("{KEY}" + token)\ntoken = (token + "other1Zq81xW")') == [KEY, "other1Zq81xW"]
    assert found("token:b1Zq81xW9vKt7Lm+token:c2Zq81xW9vKt7Lm") == ["b1Zq81xW9vKt7Lm+token:c2Zq81xW9vKt7Lm", "c2Zq81xW9vKt7Lm"]
