"""Snippets with one candidate each to learn from, since no table of the corpus marks personal data.

A snippet is filler words, a word that tells what follows (or one that speaks against it, or none), the candidate and more
filler.  Formats that no other text has (a check digit that fits, a key's prefix) are personal data with or without a telling
word; formats that invoices, versions and counts share are so only beside one.
"""
from __future__ import annotations

import random

ROWS, SEED = 14_000, 20240917

OWN = {
    "email": "email,e-mail,contact,write to,reach me:,mail me at,reply to,Kontakt:,correo,adresse".split(","),
    "ip": "ip,ip address,server,host,client,connected from,node,addr,logged in from".split(","),
    "card": "card,visa,credit card,payment by,mastercard,card number,charged to,tarjeta,carte".split(","),
    "phone": "phone,tel.,call,mobile,fax,call me on,cell,telefon,reach me by phone at,ring,number is".split(","),
    "id": "ssn,social security number,passport,passport no.,iban,account,national id,tax id,passport number is,id card,bank account".split(","),
    "secret": "key,api key,token,secret,password,credentials,access key,export,aws,login with".split(","),
}
OTHER = "order,ref,invoice,isbn,serial,version,item,page,hash,timestamp,ticket,build,flight,model,part,population,total,batch,sku,case".split(",")


def snippets(n: int = ROWS, seed: int = SEED) -> list[dict]:
    """kind, label, text of n made snippets."""
    rng = random.Random(seed)
    one, many = rng.choice, lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    mixed = lower + upper + digits
    d = lambda k: many(digits, k)
    word = lambda: many("abcdefghilmnoprstu", rng.randint(2, 9))
    groups = lambda s, sep, k=4: sep.join(s[i : i + k] for i in range(0, len(s), k))

    def luhn(k: int) -> str:
        body = one("3456") + d(k - 2)
        total = sum(int(c) if i % 2 else (int(c) * 2 - (9 if int(c) > 4 else 0)) for i, c in enumerate(reversed(body)))
        return body + str(-total % 10)

    def iban() -> str:
        land, body = one(["DE", "FR", "ES", "GB", "NL", "IT"]), d(rng.choice([14, 18, 20]))
        number = int("".join(str(int(c, 36)) for c in body + land + "00"))
        return f"{land}{98 - number % 97:02d}{body}"

    def name() -> str:
        return one([f"{word()}.{word()}", word(), f"{word()}{d(2)}", f"{word()}_{word()}"])

    end = lambda: one(["com", "org", "net", "de", "fr", "es", "io", "co.uk"])
    at, dot = lambda: one([" (at) ", "[at]", " at ", " AT ", " [AT] ", "{at}"]), lambda: one([" (dot) ", "[dot]", " dot ", " DOT ", " [DOT] "])
    octets = lambda: [str(rng.randint(1, 255)) for _ in range(4)]
    national = lambda: one([f"0{d(2)} {d(7)}", f"0{one('67')} {groups(d(8), ' ', 2)}", f"0{d(3)}/{d(6)}", f"0{d(4)}-{d(5)}", f"0{d(3)} {d(3)} {d(4)}"])
    area = lambda: f"{rng.randint(1, 665):03d}"
    password = lambda: many(lower, 4) + one("!#$%&*") + many(mixed, 4) + d(2)

    # kind -> (label, whether a telling word is needed, maker)
    makers = {
        "email": [
            (1, 0, lambda: f"{name()}{at()}{word()}{dot()}{end()}"), (1, 0, lambda: f"{name()} {one(['(at)', '[at]'])} {word()}.{end()}"), (1, 1, lambda: f"{name()}@{word()}"),
            (0, 0, lambda: f"{word()} at {word()} dot {word()} {word()}"), (0, 0, lambda: f"{word()} (at) {word()}"), (0, 0, lambda: f"{word()}@{d(1)}x"), (0, 0, lambda: f"@{word()}@{word()}"),
        ],
        "ip": [
            (1, 0, lambda: "[.]".join(octets())), (1, 0, lambda: "(.)".join(octets())), (1, 0, lambda: ":".join(many("0123456789abcdef", 4) for _ in range(8))),
            (0, 0, lambda: " . ".join(d(3) for _ in range(4))), (0, 0, lambda: "[.]".join(str(rng.randint(300, 999)) for _ in range(4))),
        ],
        "card": [
            (1, 0, lambda: groups(luhn(16), one("._/"))), (1, 1, lambda: groups(d(16), one(" -"))),
            (0, 0, lambda: d(rng.randint(13, 19))), (0, 0, lambda: groups(d(16), one("._/"))), (0, 0, lambda: groups(d(16), " ")),
        ],
        "phone": [
            (1, 0, lambda: f"({d(3)}) {d(3)}-{d(4)}"), (1, 0, lambda: f"{one('23456789')}{d(2)}-{d(3)}-{d(4)}"), (1, 1, lambda: f"{d(3)}.{d(3)}.{d(4)}"), (1, 0, lambda: f"00{one(['49', '33', '34', '1', '44'])} {d(3)} {d(3)} {d(3)}"),
            (1, 1, national), (1, 1, lambda: one("23456789") + d(9)),
            (0, 0, lambda: f"{d(3)} {d(3)} {d(4)}"), (0, 0, lambda: one("123456789") + d(9)), (0, 0, national), (0, 0, lambda: f"00{one('123456789')}-{d(2)}-{d(2)}"),
        ],
        "id": [
            (1, 0, lambda: f"{area()}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}"), (1, 0, iban), (1, 0, lambda: groups(iban(), " ")), (1, 1, lambda: many(upper, rng.randint(1, 2)) + d(rng.randint(6, 8))), (1, 1, lambda: d(9)),
            (0, 0, lambda: f"{one(['000', '666', '9' + d(2)])}-{d(2)}-{d(4)}"), (0, 0, lambda: f"{many(upper, 2)}{d(2)} {groups(many(upper + digits, 16), ' ')}"), (0, 0, lambda: many(upper, rng.randint(1, 2)) + d(rng.randint(6, 8))), (0, 0, lambda: d(9)),
        ],
        "secret": [
            (1, 0, lambda: one(["AKIA", "ASIA"]) + many(upper + digits, 16)), (1, 0, lambda: f"gh{one('pousr')}_{many(mixed, 36)}"), (1, 0, lambda: f"xox{one('bap')}-{d(11)}-{many(mixed, 24)}"), (1, 0, lambda: f"sk{one('-_')}{one(['live', 'test', 'proj'])}{one('-_')}{many(mixed, 24)}"),
            (1, 0, lambda: "AIza" + many(mixed, 35)), (1, 0, lambda: f"eyJ{many(mixed, 20)}.eyJ{many(mixed, 30)}.{many(mixed, 40)}"), (1, 0, lambda: f"{one(['password', 'secret', 'api_key', 'token', 'pwd', 'passwd'])}{one([': ', '=', ' = ', ':'])}{one([password, lambda: many(mixed, 24)])()}"),
            (0, 0, lambda: f"{one(['password', 'secret', 'token'])}{one([': ', ' = ', ':'])}{many(lower, rng.randint(6, 10))}"), (0, 0, lambda: f"{one(['secret', 'token', 'password'])}: {word()}s {word()}"), (0, 0, lambda: f"{one('sp')}k-{many(lower, 18)}"),
        ],
    }
    rows = []
    for _ in range(n):
        kind, wanted = one(list(makers)), rng.random() < 0.5
        label, needs, make = one([m for m in makers[kind] if bool(m[0]) == wanted])
        told = rng.random() < (1.0 if needs else 0.6 if label else 0.03)
        near = one(OWN[kind]) + one([" ", " ", ": "]) if told else one(OTHER) + one([" ", ": ", " no. "]) if rng.random() < (0.05 if label else 0.5) else word() + " "
        glue = one(["", one(lower + digits)]) if not label and kind != "secret" and rng.random() < 0.15 else ""
        before, after = " ".join(word() for _ in range(rng.randint(0, 6))), one([" ", ". ", ", ", "", "\n", "! "])
        rows.append({"kind": kind, "label": label, "text": f"{before} {near}{glue}{make()}{after}{word() if after else ''} {word()}"})
    return rows
