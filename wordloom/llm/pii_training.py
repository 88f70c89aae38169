"""Labelled lines for training the personal-information tagger.

All lines are made here from patterns and random parts by a fixed seed: ordinary lines,
lines with each kind of personal information, and lines with things that look alike
(order and catalogue numbers, dates, handles, web addresses, company and club names).
A line is a list of (text, label) parts; label None stands for ordinary text.
"""

from __future__ import annotations

import random
import re

# Common given names; half of the training names are random letters instead.
GIVEN = "adam alex alice amara amina andre andrew anna anne arthur ben carla carlos carol chen chloe clara daniel david diana elena elias emily emma erik eva fatima felix finn george grace greta hannah helen henry hugo ines ingrid irene ivan jack james jane jean john jonas jose julia karen karl kenji laura leila leo liam lily linda lucas lucy luis lukas maria marco marcus mark martin mary mateo max mei mia michael mila mohammed naomi nina noah nora olga oliver olivia omar oscar paul pedro peter philip priya rafael ravi richard robert rosa ruth samuel sara sarah simon sofia sophie stefan susan teresa thomas tom victor william yusuf zoe".split()
TITLES = "Dr. Mr. Mrs Ms Mrs. Ms. Prof. Professor Dr Mr".split()
STREETS = "Street St. St Road Rd Rd. Avenue Ave Ave. Boulevard Blvd Blvd. Drive Dr. Lane Ln Ln. Court Ct. Close Way Place Terrace Square".split()
TOP = "example test invalid com org net edu io info co.uk de fr co.jp dev tv film".split()

# Common words for sentences of no set pattern, and forms of numbers and
# addresses in several countries (d a digit, L a capital letter, S a made-up name, T a town).
NOUNS = "boat house garden table river song story bread camera school window market train winter summer paper bridge kitchen mountain village dog cat horse engine guitar piano book letter tower museum forest island coffee dinner party team class lesson video episode song channel show stage street road office shop studio workshop tool knife wood stone glass paint colour light sound music film picture photo week month year hour minute price money job question answer idea problem plan project game match player crowd child woman man friend neighbour teacher doctor driver farmer cook singer".split()
VERBS = "makes builds shows explains teaches plays sings paints cooks writes reads drives walks runs finds takes gives keeps brings leaves meets asks tells says thinks loves likes hates needs wants helps opens closes starts ends joined visited called invited thanked interviewed met saw helped taught drove built wrote painted played filmed recorded edited asked told said left came went stayed lives works studied was is has had will can did".split()
SMALL = "the a an this that these those my your our his her their some any every each no one two three and or but so because when while after before until since if then than as at by for from in into of on onto over under with without about around near behind between to up down out off again also always never often soon today yesterday tomorrow here there now very quite too just only still even not it we you they he she who which what how why where please thanks".split()
FOREIGN = "el la los las un una unos de del para por con sin no se te tu su y que en es muy m\u00e1s pr\u00f3ximo siguiente perderte suscr\u00edbete mira aqu\u00ed hoy nuestro video le les une des du et pour avec dans sur vous nous est pas plus notre votre abonnez der die das und ein eine mit f\u00fcr auf nicht ist wir sie von zu den dem unser neue il lo gli che per non ti os as um uma com n\u00e3o nosso".split()
ROLES = "director producer editor host guest camera sound light script voice narrator author composer conductor pianist violin cello drums guitar vocals photographer designer animator translator researcher actor coach captain mayor president chef colleague friend brother sister mother father wife husband uncle aunt neighbour teacher".split()
PHONES = "+1 ddd ddd dddd|+1-ddd-ddd-dddd|(ddd) ddd-dddd|1-800-ddd-dddd|ddd-ddd-dddd|ddd.ddd.dddd|+44 dddd dddddd|0dddd dddddd|0ddd dddd dddd|0dd dddd dddd|+44 20 dddd dddd|+33 d dd dd dd dd|0d dd dd dd dd|+49 dd ddddddd|+49 ddd ddddddd|0dd ddddddd|(0dd) ddd dd dd|0ddd ddddddd|0ddd/ddddddd|+34 ddd ddd ddd|+39 dd dddd dddd|+31 dd ddd dddd|+91 ddddd ddddd|+61 d dddd dddd|+81 d-dddd-dddd|+81 dd-dddd-dddd|+55 dd ddddd-dddd|+52 dd dddd dddd|+48 ddd ddd ddd|+46 dd ddd dd dd|+47 ddd dd ddd|+41 dd ddd dd dd|+353 dd ddd dddd|+27 dd ddd dddd|+234 ddd ddd dddd|+86 ddd dddd dddd|+7 ddd ddd-dd-dd|00dd dd ddddddd|+ddddddddddd|0dddddddddd".split("|")
CALLS = "call|call us on|phone|phone:|tel|tel.|tel:|telephone|mobile|mobile:|cell|fax|text|ring|whatsapp|sms|number:|our number is|my number is|reach us at|hotline|bookings|tickets:|dial|viber|signal".split("|")
PAPERS = "social security number=ddd-dd-dddd|social security=ddd-dd-dddd|SSN=ddd-dd-dddd|SSN=ddddddddd|aadhaar=dddd dddd dddd|aadhaar number=dddd dddd dddd|aadhaar=dddddddddddd|PAN=LLLLLddddL|passport=LLddddddd|passport number=ddddddddd|passport no.=Ldddddddd|passport no=LLdddddd|travel document=Ldddddddd|national ID=ddddddddddddd|national ID number=dddddddddd|identity card=ddddddddd|Ausweisnummer=LddLddddd|Personalausweis=LLddLdddd|identity number=ddddddddddddd|ID card number=LLddddddd|ID card no.=ddddddddd|ID number=dddddddddd|personal number=dddddd-dddd|driver's license=Lddd-dddd-dddd|driving licence=LLLLLddddddLLdLL|driving licence number=LLLLLddddddLLdLL|driver license no.=dddddddd|licence number=LLdddddd|NI number=LL dd dd dd L|National Insurance=LLddddddL|NINO=LLddddddL|tax ID=dd-ddddddd|tax number=ddd-dd-dddd|tax identification number=ddddddddddd|TIN=ddd-dd-dddd|ITIN=ddd-dd-dddd|Steuer-ID=dd ddd ddd ddd|Steuernummer=dd/ddd/ddddd|DNI=ddddddddL|NIE=LdddddddL|NIF=ddddddddL|CPF=ddd.ddd.ddd-dd|CURP=LLLLddddddLLLLLLdd|codice fiscale=LLLLLLddLddLdddL|numero de securite sociale=d dd dd dd ddd ddd dd|SIN=ddd ddd ddd|social insurance number=ddd-ddd-ddd|BSN=ddddddddd|PESEL=ddddddddddd|CNP=ddddddddddddd|health card=dddd ddd ddd|Medicare number=dddd ddddd d|NHS number=ddd ddd dddd|voter ID=LLLddddddd|residence permit=LLddddddd|visa number=dddddddd".split("|")
PLACES = "N S Street, T|N S Road, T ddddd|N S Avenue|N S Lane, T|N S Close, T LLd dLL|N S Crescent, T|N S Plaza|N S Parkway, T, LL ddddd|N S Street, T, LL ddddd|N S Street NW, T, LL ddddd|N S Drive, T|N S Hill, T LLd dLL|N S Gardens, T|N S Court|N S Terrace, T|N S Square, T|N S Boulevard, T, LL ddddd|N S Highway, T|N S Row, T|N S Walk|N S Grove, T|N S Mews, T|N S Quay, T|Nb S Street, T|Flat N, N S Road, T|Apt N, N S Street, T|Suite N, N S Avenue, T, LL ddddd|Unit N, N S Road, T|Fifth Floor, N S Street, T|N rue S, ddddd T|N rue de la S, ddddd T|N Rue du S, ddddd T|N avenue de S, ddddd T|N place de la S, T|N boulevard S, ddddd T|N Quai S, T|Via S N, ddddd T|Via S, N, ddddd T|Piazza S N, T|Viale S N, ddddd T|Corso S N, T|Calle S N, ddddd T|Avenida S N, T|Plaza S N, T|Rua S N, T|Av. S, N, T|Sstra\u00dfe N, ddddd T|Sstrasse N, dddd T|Sweg N, ddddd T|Splatz N, ddddd T|Sallee N, T|Am S N, ddddd T|Unter den S N, T|Sgracht N, dddd LL T|Slaan N, dddd LL T|Sstraat N, T|Sgatan N, ddd dd T|Sgade N, dddd T|Sveien N, T|ul. S N, dd-ddd T|PO Box dddd, T|P.O. Box ddd, T ddddd|Postfach dddd, ddddd T|Box dddd, T".split("|")
#: Share of lines of no set pattern.
FREE = 0.5


class Maker:
    def __init__(self, seed: int):
        self.r = random.Random(seed)
        pick = lambda n, k: [self.letters(3, 9) for _ in range(n)] if k else []
        ends = ["", "", "ate", "ton", "er", "en", "let", "ing", "ed", "son", "y", "ley", "field", "ow", "man", "book", "ook", "gate", "wick", "low", "ard"]
        words = lambda n: [w + self.r.choice(ends) for w in pick(n, 1)]
        # Words of addresses and names also stand in ordinary text.
        self.things, self.acts, self.towns = [*words(80), "square", "place", "box", "way", "unit", "lane"], words(80), [w.capitalize() for w in pick(40, 1)]
        self.likes = [*words(70), *(f"{a}-{b}" for a, b in zip(pick(8, 1), pick(8, 1))), "square", "close", "square", "court", "hand-cut"]

    def letters(self, a: int, b: int) -> str:
        r, out = self.r, ""
        while len(out) < r.randint(a, b):
            out += r.choice("bcdfghjklmnprstvwz") + r.choice("aeiou") + r.choice(["", "", "n", "r", "l", "st", "ck"])
        return out

    def digits(self, shape: str) -> str:
        return "".join(self.r.choice("0123456789") if c == "d" else self.r.choice("ABCDEFGHKLMNPRSTWXYZ") if c == "L" else c for c in shape)

    def noun(self) -> str:
        return self.r.choice(self.things)

    def adj(self) -> str:
        return self.r.choice(self.likes)

    def verb(self) -> str:
        return self.r.choice(self.acts)

    def town(self) -> str:
        return self.r.choice(self.towns)

    def first(self) -> str:
        return (self.r.choice(GIVEN) if self.r.random() < 0.6 else self.letters(3, 6)).capitalize()

    def last(self) -> str:
        r = self.r
        w = self.letters(3, 7) + r.choice(["son", "sen", "wick", "field", "ova", "man", "ley", "by", "worth", "brook", "ton", "tti", "ska", "nau", "hurst", "kins", "low", "gate", ""])
        w = w.capitalize()
        return f"{w}-{self.letters(3, 6).capitalize()}" if r.random() < 0.04 else "O'" + w if r.random() < 0.02 else w

    def name(self) -> str:
        r, f, g = self.r, self.first(), self.last()
        s = r.choice([f"{f} {g}"] * 5 + [f"{f} {self.digits('L')}. {g}", f"{f} {self.digits('L')}. {g}", f"{g}, {f}", f"{g}, {f}", f"{r.choice(TITLES)} {g}", f"{r.choice(TITLES)} {f} {g}", f"{r.choice(TITLES)} {g}"])
        return s.upper() if r.random() < 0.15 else s

    def email(self) -> str:
        r, f, g = self.r, self.first().lower(), self.last().lower()
        local = r.choice([f"{f}.{g}", f"{f}_{g}", f"{g}_{f}", f"{f[0]}{g}", f"{f}{r.randint(1, 99)}", f"{f}-{g}", f"{f}.{g}+video", f"{r.choice(['studio', 'info', 'office', 'hello', 'press'])}"])
        host = self.letters(3, 8) + r.choice(["", "post", "works", "films", "mail", "-studio", ".mail", str(r.randint(1, 99))])
        top, form = r.choice(TOP), r.randrange(8)
        if form < 3:
            s = f"{local}@{host}.{top}"
        elif form == 3:
            s = f"{local} @ {host}.{top}"
        elif form == 4:
            s = f"{local}[at]{host}[dot]{top}"
        elif form == 5:
            s = f"{local} (at) {host} (dot) {top}"
        elif form == 6:
            s = f"{local} AT {host} DOT {top}"
        else:
            s = f"{local}\uff20{host}.{top}"
        return s.upper() if r.random() < 0.1 else s

    def phone(self) -> str:
        shapes = ["(ddd) ddd-dddd", "ddd-ddd-dddd", "ddd.ddd.dddd", "ddd ddd dddd", "+1 ddd ddd dddd", "+1-ddd-ddd-dddd", "+1.ddd.ddd.dddd", "1dddddddddd", "+44 dddd dddddd", "+44 (0)dd dddd dddd", "0dd dddd dddd", "0dddd dddddd", "0dddd-dddddd", "0dddd.dddddd", "0049 dd ddddd-ddd", "+49 dd ddddd ddd", "(0dd) ddddd ddd", "ddd/ddd-dddd ext. dd", "0dddddddddd", "+dd d dd dd dd dd", "ddd‑ddd‑dddd", "0dddd‑dddddd", "ddd-dddd"]
        return self.digits(self.r.choice(shapes[:-1] if self.r.random() < 0.97 else shapes))

    def identity(self) -> tuple[str, str]:
        """The words that lead to a number, and the number."""
        r = self.r
        kind = r.randrange(8)
        if kind == 0:
            return r.choice(["My social is ", "social security no. ", "soc. sec. #: ", "SSN ", "SSN: ", "social security number "]), self.digits(r.choice(["ddd-dd-dddd", "ddd dd dddd"]))
        if kind == 1:
            return r.choice(["tax ID ", "tax id: ", "TIN ", "tax number "]), self.digits(r.choice(["ddd-dd-dddd", "dd-ddddddd", "dd ddd ddd ddd"]))
        if kind == 2:
            return r.choice(["National Insurance ", "NI number ", "National Insurance no. "]), self.digits(r.choice(["QQ dd dd dd L", "LL dd dd dd L", "LLddddddL"]))
        if kind in (3, 4):
            return r.choice(["passport number ", "passport no. ", "Passport: ", "passport ", "pasaporte "]), self.digits(r.choice(["Lddddddd", "LLddddddd", "ddddddddd"]))
        if kind == 5:
            return r.choice(["DNI ", "D.N.I.: ", "DNI: ", "NIE "]), self.digits(r.choice(["ddddddddL", "dddddddd-L", "Lddddddd-L"]))
        return r.choice(["driver's license ", "driver\u2019s licence ", "DL# ", "licence no ", "license no. ", "licence number "]), self.digits(r.choice(["Lddd-dddd-dddd", "Ldddddddd", "dddddddd"]))

    def address(self) -> str:
        r, s, t = self.r, self.letters(4, 8).capitalize(), self.town()
        n = r.randint(1, 999)
        z = self.digits("ddddd")
        form = r.randrange(9)
        if form == 0:
            a = f"{n} {r.choice(['', 'N. ', 'W. ', 'S. ', 'E. '])}{s} {r.choice(STREETS)}, Apt {r.randint(1, 30)}{r.choice('ABC')}, {t} {z}"
        elif form == 1:
            a = f"{n} {s} {r.choice(STREETS)}, {t}"
        elif form == 2:
            a = f"{n}{r.choice('abcd')} {s} {r.choice(STREETS)} / {t}"
        elif form == 3:
            a = f"Unit {r.randint(1, 30)}, {n} {s} {r.choice(STREETS)}, {t}".upper()
        elif form == 4:
            a = f"{r.choice(['PO box', 'P.O. Box', 'P.O. box', 'Post box', 'PO Box'])} {self.digits('dddd')}, {t}{r.choice(['', ' ' + z])}"
        elif form == 5:
            a = f"Calle {s} {n}, {r.randint(1, 9)}\u00ba {r.choice('ABC')}, {t}"
        elif form == 6:
            a = f"{s}{r.choice(['weg', 'stra\u00dfe', 'str.', 'gasse'])} {r.randint(1, 120)}, {z} {t}"
        elif form == 7:
            a = f"{n} {s} {r.choice(STREETS)}"
        else:
            a = f"{s}{r.choice(['weg', 'weg', 'platz'])} {r.randint(1, 120)}, {z} {t}"
        return a

    def camel(self) -> str:
        return (self.adj().title() if self.r.random() < 0.5 else self.adj().replace("-", "").capitalize()) + self.noun().capitalize() + self.r.choice(["", "", str(self.r.randint(1, 99))])

    def plain(self) -> list:
        """An ordinary line, often with numbers or names of things."""
        r, n, a, v, t = self.r, self.noun, self.adj, self.verb, self.town
        k = self.digits(r.choice(["ddd", "dddd", "ddddd"]))
        url = f"https://{self.letters(4, 9)}.{r.choice(TOP)}/p/{k}?ref={self.digits('dddddd')}"
        day = r.choice(["Monday", "Saturday", "morning", "summer", "winter", "season"])
        tail = f" ({a()} {n()} {k})" if r.random() < 0.2 else ""
        return [(r.choice([
            f"If your {n()} is {a()}, {v()} the {n()} first and {v()} it {a()}.", f"Don't {v()} it {a()}; the {n()} turns {a()} and you are left with a {n()}", f"It took {r.randint(2, 40)} tries to {v()} that {n()}, and the {n()} came out {a()}!", f"The {a()} {n()} costs about {k} coins, the {a()} one rather less.", f"We {v()} the {a()} {n()} {a()} before the {n()} gets {a()}.",
            f"In this video we {v()} a {a()} {n()}, then {v()} the {a()} {n()} {a()}.", f"Order no. {self.digits('dddd-dddd-dd')} of the {a()} {n()} and {a()} {n()} arrived", f"Catalogue number {self.digits('ddd.ddd.ddd')}, batch {k}, {a()} {n()}",
            f"With the {a().capitalize()} {n().capitalize()} Mark {r.randint(1, 9)} and a {a()} {n()}, serial {self.digits('dddd')}-{k}", f"Serial number {self.digits('dddddddd')}, model {self.digits('LLddd')}", f"Inspired by @{n()}{n()}{k} and the {a()} {n()}",
            f"Recorded on the road between {t()} and {t()} with the {a()} {n()} no. {k}", f"Meet us at the {a()} {n()} fair in {t()}, stand {k}", f"{r.randint(1, 60)} @ {r.randint(1, 99)} coins each for the {a()} {n()}, lot {k}",
            f"Special thanks to {t()} Hardware, shelf {k}, for the {n()}", f"Thanks to the {t()} Library for the {n()}", f"Guest: the {t()} Town Choir, {k} voices", f"Guest: the {t()} {r.choice(['Band', 'Team', 'Rowing Club'])}", f"Filmed by the {t()} Film Club, reel {k}",
            f"Edited by {self.camel()} Media, job {k}", f"Edited by {a().capitalize()} {n().capitalize()} Media", f"Send your {n()} pictures with the tag #{self.camel()}", f"All footage \u00a9 {self.camel()}, no reuse without written consent",
            f"Written, filmed and edited by the {self.camel()} team", f"New here? Start with our playlist {a()} {n()} basics", f"Ce programme est propos\u00e9 par {self.camel()}, tous droits r\u00e9serv\u00e9s", f"Follow the workshop diary at {url}", f"Plans: {url}", f"Merch and stickers: {url}",
            f"Music: \"{a().capitalize()} {n().capitalize()}\", take {k}", f"Music licensed from the {a()} {n()} library", f"{r.randint(1, 12)}/{r.randint(1, 28)}/20{self.digits('dd')} - {self.digits('dddddddd')} views of the {a()} {n()} since", f"Temperature {self.digits('ddd')}-{self.digits('ddd')} degrees, {self.digits('ddd')} g {n()}, {self.digits('ddd')} ml {a()} {n()}",
            f"{r.randint(0, 9)}:{self.digits('dd')} {a()} {n()} and the {a()} {n()} number {k}", f"{r.randint(2, 20)} ways to {v()} the {a()} {n()} in {t()}, part {k}", f"#{a()}{n()} #{n()}{k} #{n()}", f"Find us everywhere as @{self.camel()}", f"Join the {self.camel()} club and get the plans one week early",
            f"Camera and lights: {a()} {n()} kit, see {url}", f"Subscribe for a new {n()} project every {day}", f"Do not try this without gloves, goggles and a {a()} {n()}", f"This upload is part {day} of the {a()} {n()} challenge", f"{self.camel()} takes part in partner programmes of several {n()} makers",
            f"Step {r.randint(1, 9)}: {v()} the {n()}, {v()} the {n()}, and {v()} everything {a()}", f"At {r.randint(1, 12)}:{self.digits('dd')} the {n()} is {a()} enough to {v()}.", f"After {r.randint(2, 90)} minutes the {n()} looked {a()}, so I had to {v()} it {a()}.", f"That {day} we drove to {t()} to {v()} the {n()} and {v()} the {n()}.",
            f"Nobody in {t()} would {v()} a {a()} {n()} on a {day} like this.", f"{t()} has a {a()} {n()} market every {day}.", f"A {a()} {n()} is {r.randint(2, 90)}% lighter than the {a()} {n()} we used in {t()}.", f"Hit the bell so that you never miss a {n()}", f"The views in this video are those of the speakers and not of {self.camel()}",
            f"Who taught you to {v()} a {n()} with a {a()} {n()}?", f"\"{v().capitalize()} it {a()},\" they said, \"or the {a()} {n()} will stick.\"", f"Our new {n()} comes to {t()} on {r.randint(1, 28)} May 20{self.digits('dd')}", f"{t()} and {t()} in one {day}", f"Captions were made by machine and may contain mistakes",
            f"Support us from the price of one {a()} {n()} per month", f"Invoice {self.digits('dddddd')} for {r.randint(1, 40)} {n()}s, {self.digits('dddd')} in all", f"Version {r.randint(1, 9)}.{r.randint(0, 9)}.{self.digits('dd')} of the {n()} app", f"I was {a()} when the {n()} did not {v()} {a()}.", f"My {a()} {n()} still works, which makes me {a()}.",
            f"Letters and {a()} parcels are welcome in {t()}", f"Call us if the {n()} turns {a()}", f"Presented in {t()} by the {self.camel()} team", f"Any likeness to a real {n()} is accidental", f"Thumbs up if the {a()} {n()} made you smile", f"Share this video with a friend who likes a good {n()}",
        ]) + tail, None)]

    def personal(self) -> list:
        """A line with personal information of one kind."""
        r, n, a, t = self.r, self.noun, self.adj, self.town
        kind = r.choice(["E", "P", "I", "A", "N", "N", "A", "I"])
        day = r.choice(["Mondays", "weekends", "mornings", "summers", "seasons"])
        if kind == "E":
            e = self.email()
            return r.choice([[("contact -> ", None), (e, "E")], [("For bookings write to ", None), (e, "E")], [("Mail me: ", None), (e, "E")], [(e, "E"), (" is the quickest way to reach me", None)], [("Questions go to ", None), (e, "E")], [(f"complaints about the {a()} {n()} -> ", None), (e, "E")], [(f"Sponsorship, press and {a()} {n()} swaps: ", None), (e, "E")], [("Mail me: <mailto:", None), (e, "E"), (">", None)], [(f"{a()} {n()}, ", None), (e, "E"), (f" or the {n()}", None)]])
        if kind == "P":
            p = self.phone()
            return r.choice([[("Office hours by phone: ", None), (p, "P")], [("Call or text ", None), (p, "P"), (" before noon", None)], [("Workshop line: ", None), (p, "P")], [("WhatsApp ", None), (p, "P"), (f" for the {n()} course", None)], [("ring ", None), (p, "P"), (f" and ask for the {a()} {n()}", None)], [("\u260e ", None), (p, "P")], [(f"Orders ({n()} only): ", None), (p, "P")], [(f"{a()} {n()}, phone ", None), (p, "P")], [("Tel. ", None), (p, "P")], [(f"{n()} questions? ", None), (p, "P")]])
        if kind == "I":
            w, i = self.identity()
            return r.choice([[(f"{w}", None), (i, "I"), (" (yes, they really asked for that)", None)], [(f"Refund form says {w}", None), (i, "I"), (", please keep it on file", None)], [(f"Raffle winner identified by {w}", None), (i, "I")], [(f"For the customs people again: {w}", None), (i, "I")], [(f"The {n()} form wants {w}", None), (i, "I")]])
        if kind == "A":
            s = self.address()
            return r.choice([[("Our shop: ", None), (s, "A")], [("we moved! ", None), (s, "A")], [("come by, ", None), (s, "A"), (f", bell marked {n()}", None)], [(f"Studio visits on {day} at ", None), (s, "A")], [(f"Post your {n()} to ", None), (s, "A")], [(f"Letters and {a()} parcels: ", None), (s, "A")], [(f"{self.camel()} productions, ", None), (s, "A")], [(f"{a().capitalize()} {n()} at ", None), (s, "A")]])
        m = self.name()
        return r.choice([[("Presented by ", None), (m, "N")], [(m, "N"), (f" is the voice of {self.camel()}", None)], [("Special thanks to ", None), (m, "N"), (f" for the {n()}", None)], [("Guest: ", None), (m, "N")], [("Edited by ", None), (m, "N")], [("Filmed by ", None), (m, "N"), (f" with a {a()} {n()}", None)], [("With ", None), (m, "N"), (f" and a {a()} {n()}", None)], [("Yesterday ", None), (m, "N"), (f" and I went to {t()} for a {n()}", None)], [("My neighbour ", None), (m, "N"), (f" lent me the {n()}", None)], [(f"The {a()} {n()} was built by ", None), (m, "N"), (f" in {t()}", None)], [("In memory of ", None), (m, "N"), (f", who loved a {a()} {n()}", None)], [("Host / camera: ", None), (m, "N")], [(m, "N"), (f" asked for this one, so blame them for the {n()}", None)], [("Interview with ", None), (m, "N"), (f" from {t()}", None)], [(m, "N"), (f" {self.verb()}s the {n()}", None)]])

    def shaped(self, shape: str) -> str:
        """A form with its letters filled in."""
        r, out = self.r, ""
        for c in re.split(r"(\bN(?=[b,. ]|$)|\bS|\bT\b|dd*|\bLL?\b(?![a-z])|L)", shape):
            if c == "N":
                out += str(r.randint(1, r.choice([30, 400, 2000])))
            elif c == "S":
                out += self.letters(4, 8).capitalize() + r.choice(["", "", "", "", " " + self.letters(4, 7).capitalize(), "-" + self.letters(4, 7).capitalize()])
            elif c == "T":
                out += self.town() + r.choice(["", "", "", " " + self.letters(3, 7).capitalize()])
            elif c and set(c) <= set("dL"):
                out += self.digits(c)
            else:
                out += c
        return out

    def anyone(self) -> str:
        """A full name, or a title and a name, as in several languages."""
        r, f, g = self.r, self.first(), self.last()
        if r.random() < 0.3:
            g = (self.letters(4, 10) + r.choice(["", "ez", "ski", "ova", "idis", "eira", "ini", "wala", "oglu", "sson", "mura", "dottir", "an", "uk", "ra", "wu"])).capitalize()
        if r.random() < 0.12:
            g = self.letters(2, 3).capitalize()
        s = r.choice([f"{f} {g}"] * 8 + [f"{f} {self.first()} {g}", f"{f} {g} {self.last()}", f"{f}-{self.first()} {g}", f"{f} {self.digits('L')}. {g}", f"{self.digits('L')}. {g}", f"{self.digits('L')}. {self.digits('L')}. {g}", f"{f} {r.choice(['van', 'de', 'von', 'del', 'da', 'bin', 'al', 'van der', 'di', 'la'])} {g}", f"{f} {r.choice(['Mc', 'Mac', 'O\u2019', 'D\u2019'])}{g}", f"{r.choice(TITLES)} {g}", f"{r.choice(TITLES)} {g}", f"{r.choice(TITLES)} {f} {g}"])
        if r.random() < 0.1:
            s = s.translate(str.maketrans("aeou", r.choice(["\u00e1\u00e9\u00f3\u00fa", "\u00e4eo\u00fc", "ae\u00f8u"])))
        return s

    def words(self, n: int) -> str:
        """n words in a row without any meaning, as context of no pattern."""
        r = self.r
        pick = lambda: r.choice([r.choice(SMALL), r.choice(SMALL), r.choice(NOUNS), r.choice(VERBS), r.choice(ROLES), self.noun(), self.adj()])
        return " ".join(pick() for _ in range(n))

    def sentence(self) -> str:
        """Plain text with capitals and numbers that are nobody's."""
        r, n, v, t = self.r, lambda: r.choice(NOUNS), lambda: r.choice(VERBS), self.town
        x = lambda: self.letters(3, 8).capitalize()
        num = self.digits(r.choice(["d", "dd", "ddd", "dddd", "d.d", "dd.dd", "d,ddd", "dddd-dd-dd", "d:dd", "dd:dd", "dddd-ddd-dd", "ddd-d-dd-dddddd-d", "LL-dddd", "dddddd"]))
        return r.choice([
            f"{self.words(r.randint(2, 6))} {x()} {self.words(r.randint(1, 4))}", " ".join(r.choice([r.choice(FOREIGN), r.choice(FOREIGN), self.noun(), n()]) for _ in range(r.randint(4, 9))).capitalize(), " ".join(r.choice([r.choice(FOREIGN), r.choice(FOREIGN), self.noun(), n()]).capitalize() for _ in range(r.randint(4, 9))), f"{self.words(3)} {num} {self.words(3)}", f"{r.choice(SMALL).capitalize()} {n()} {v()} {r.choice(SMALL)} {n()}.", f"{v().capitalize()} {r.choice(SMALL)} {n()} {r.choice(SMALL)} {t()}", f"the {x()} {r.choice(['River', 'Lake', 'Castle', 'Museum', 'Library', 'Festival', 'Orchestra', 'Band', 'Choir', 'University', 'Team', 'Club', 'Hall', 'Forest', 'Coffee', 'Records', 'Studios', 'Films', 'Foundation', 'Company'])} {v()} {self.words(2)}",
            f"{x()} {x()} {r.choice(['Festival', 'Orchestra', 'Records', 'Studios', 'Productions', 'Roasters', 'Library', 'Awards', 'Ltd', 'Inc', 'Group', 'Museum', 'Hall'])}", f"{r.choice(['Lake', 'Mount', 'New', 'North', 'South', 'San', 'Port', 'Saint', 'Isle of', 'Cape'])} {x()} {self.words(2)}", " ".join(w.capitalize() for w in self.words(r.randint(3, 7)).split()), f"\"{' '.join(w.capitalize() for w in self.words(r.randint(2, 4)).split())}\" {self.words(2)} {x()}",
            f"{r.choice(['Order number', 'Order', 'Invoice', 'Serial', 'Serial number', 'Batch', 'Model', 'Part no.', 'Catalogue no.', 'Lot', 'Version', 'Firmware', 'ISBN', 'Tracking number', 'Ticket', 'Reference', 'Room', 'Chapter', 'Episode', 'Flight', 'Article', 'Product code'])} {self.digits(r.choice(['dddd', 'dddd-ddd-dd', 'dddddd', 'LL-dddd', 'ddd-d-dd-dddddd-d', 'dddddddd', 'd.d.d', 'LLdddd', 'ddddd-L', 'dddddddddd', 'ddd.ddd.ddd']))} {self.words(2)}",
            f"{self.words(2)} {self.digits('dd')}:{self.digits('dd')} - {self.digits('dd')}:{self.digits('dd')} {' '.join(w.capitalize() for w in self.words(3).split())}", f"{r.randint(1, 28)} {r.choice(['January', 'March', 'May', 'July', 'August', 'October', 'December'])} {self.digits('dddd')}, {self.words(3)}", f"{self.digits('dd')},{self.digits('ddd')} {r.choice(['people', 'km', 'views', 'euros', 'seats', 'EUR', 'g'])} {self.words(3)}", f"Coordinates: {self.digits('dd.dddd')} N, {self.digits('d.dddd')} W", f"the {x()} {self.digits('LLL dddL')} {n()} or the {x()} {self.digits('LLdddL')}", f"@{self.letters(4, 9)} and https://www.{self.letters(4, 8)}.example/{self.letters(3, 5)}?id={self.digits('ddddd')}",
        ])

    def free(self) -> list:
        """A line of no set pattern: plain sentences, or one item among other words."""
        r, n = self.r, lambda: r.choice(NOUNS)
        if r.random() < 0.06:
            # Runs of words nobody knows, of one word too.
            some = [r.choice([self.noun, self.adj, self.verb])() for _ in range(r.choice([1, 1, 2, 9]))]
            return [(" ".join(r.choice(some) for _ in range(r.choice([4, 12, 40]))) + r.choice(["", ". " + self.sentence()]), None)]
        if r.random() < 0.34:
            return [(" ".join(self.sentence() for _ in range(r.randint(1, 2))), None)]
        kind = r.choice("NNNNNNEPPIIAAA")
        if kind == "N":
            m, v, role = self.anyone(), r.choice(VERBS), r.choice(ROLES)
            lead, tail = r.choice([
                (f"{r.choice(['we', 'they', 'I', 'he', 'she', 'you'])} {r.choice(VERBS)} ", f" {self.words(r.randint(1, 5))}"), ("", f" {v} {self.words(r.randint(2, 6))}."), ("", f", {self.words(2)}, {v} {self.words(2)}"), (f"{self.words(r.randint(1, 6))} by ", ""), (f"{self.words(r.randint(1, 5))} {r.choice(['with', 'from', 'to', 'for', 'of', 'and', 'by', 'like', 'thanks to', 'according to', 'meet', 'featuring', 'feat.', 'starring'])} ", f" {self.words(r.randint(1, 4))}"), (f"{role}: ", ""), (f"{role.capitalize()}: ", f" / {r.choice(ROLES)}: someone else"), (f"{role.capitalize()} and {r.choice(ROLES)}: ", ""),
                (f"{r.choice(['my', 'our', 'her', 'his', 'their', 'the'])} {role} ", f" {r.choice(VERBS)} {self.words(2)}"), (f"{r.choice(['my', 'our', 'her', 'his', 'their', 'the'])} {role} ", "."), ("", f" - {role}"), ("", f" ({role})"), (f"{role}s ", f" and {self.anyone().split()[0].lower()}"), (f"a {n()} by ", ""), (f"{r.choice(['Many', 'Special', 'Big', ''])} thanks to ", f", who {v} the {n()}"), (f"{r.choice(['Yours', 'Regards', 'Signed', 'Love', 'Cheers'])}, ", ""), (f"{self.words(3)}. ", f" {v} {self.words(3)}"), (f"{self.words(2).capitalize()} ", ""), ("", ""),
            ])
            parts = [(lead, None), (m, "N"), (r.choice(["", "", "'s " + n()]) if tail[:1] == " " else "", None), (tail, None)]
            if r.random() < 0.15:
                parts = [(lead, None), (m, "N"), (r.choice([", ", " and ", " & "]), None), (self.anyone(), "N"), (tail, None)]
            return [p for p in parts if p[0]]
        before = self.words(r.randint(1, 6)) if r.random() < 0.7 else ""
        after = self.words(r.randint(1, 4)) if r.random() < 0.5 else ""
        if kind == "E":
            item, lead = self.email(), r.choice(["", "email: ", "mail ", "write to ", "contact ", "", "reach me at "])
        elif kind == "P":
            item, lead = self.digits(r.choice(PHONES)), r.choice(CALLS) + " "
            lead = lead.capitalize() if r.random() < 0.4 else lead
        elif kind == "I":
            name, shape = r.choice(PAPERS).split("=")
            item, lead = self.digits(shape), name + r.choice([" ", ": ", " is ", " - ", " no. ", ", "])
            lead = r.choice(["", "my ", "her ", "his ", "the ", "our "]) + (lead.lower() if r.random() < 0.2 else lead)
        else:
            item, lead = self.shaped(r.choice(PLACES)), r.choice(["at ", "address: ", "visit us at ", "to ", "", ": ", "live at ", "office, ", "shop: ", "from ", "near ", "is at "])
        mark = r.choice(["", "", "", ".", "!", ",", " (", ")", ";"]) if after or r.random() < 0.4 else ""
        return [p for p in [(before + (" " if before else "") + lead, None), (item, kind), (mark + (" " if after else "") + after, None)] if p[0]]

    def line(self) -> list:
        r = self.r
        if r.random() < FREE:
            # Names in small letters are known by what leads to them only.
            parts = self.free()
            return self.dressed(parts, not any(x == "N" for _, x in parts))
        parts = self.personal() if r.random() < 0.6 else self.plain()
        more = r.random()
        if parts[-1][1] or len(parts) > 1:
            if more < 0.08:
                parts = parts + [(" (ask for ", None), (self.name(), "N"), (")", None)]
            elif more < 0.14:
                parts = parts + [(", mail ", None), (self.email(), "E")]
            elif more < 0.2:
                parts = parts + [(", phone ", None), (self.phone(), "P")]
            elif more < 0.26:
                parts = parts + [(", at ", None), (self.address(), "A")]
        if r.random() < 0.35:
            parts = parts + [(". " if not parts[-1][0].endswith(".") else " ", None)] + self.plain() if r.random() < 0.6 else self.plain() + [(" ", None)] + parts
        return self.dressed(parts)

    def dressed(self, parts: list, lower: bool = True) -> list:
        """The line in some other case, with other marks, or between marks."""
        r = self.r
        look = r.random()
        if lower and look < 0.12:
            parts = [(s.lower(), x) for s, x in parts]
        elif look < 0.22:
            parts = [(s.upper(), x) for s, x in parts]
        elif look < 0.25:
            parts = [(s.title(), x) for s, x in parts]
        swap = r.random()
        if swap < 0.06:
            parts = [(s.replace(", ", " \u2014 "), x) for s, x in parts]
        elif swap < 0.1:
            parts = [(s.replace(": ", " - "), x) for s, x in parts]
        elif swap < 0.16:
            parts = [(s.replace(" ", "  "), x) for s, x in parts]
        dress = r.random()
        if dress < 0.2:
            a, b = r.choice([("[", "]"), ("**", "**"), ("- ", ""), ("\u2022 ", ""), (">> ", ""), ("\U0001f525 ", ""), ("", "!!!"), ("", " \u2192"), ("~ ", ""), ("", ".")])
            parts = [(a, None)] + parts + [(b, None)]
        return [p for p in parts if p[0]]


def lines(n: int, seed: int = 11) -> list[list]:
    """n labelled lines; equal arguments give equal lines. Words change every 500 lines."""
    out, maker = [], None
    for i in range(n):
        if i % 500 == 0:
            maker = Maker(seed * 1000 + i)
        out.append(maker.line())
    return out


def documents(n: int, seed: int = 12) -> list[list]:
    """n texts of some lines each, in which one name or number is said again and again."""
    out = []
    for i in range(n):
        m = Maker(seed * 1000 + i)
        doc = [m.line() for _ in range(m.r.randint(2, 5))]
        said = [(s, x) for ln in doc for s, x in ln if x in ("N", "P", "I")]
        if said:
            s, x = m.r.choice(said)
            doc.append(m.r.choice([[(f"{m.noun()} {m.adj()} ", None), (s, x)], [(s, x), (f" {m.verb()} {m.noun()}", None)], [(f"{m.adj()} ", None), (s, x), (f", {m.noun()}", None)]]))
        m.r.shuffle(doc)
        out.append(doc)
    return out
