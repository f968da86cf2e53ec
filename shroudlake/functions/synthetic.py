"""Synthetic values: short vocabularies by locale, and templates over pseudo-random draws."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import luhn_check_digit, mod97
from .crypto import draw, draw_int, pick

FIRST = {
    "en_US": ["Ada", "Blake", "Carla", "Dennis", "Elaine", "Frank", "Gloria", "Howard", "Irene", "Jasper", "Karen", "Leroy", "Mabel", "Nolan", "Opal", "Perry", "Quinn", "Rosa", "Stanley", "Trudy"],
    "tr_TR": ["Aylin", "Baran", "Ceren", "Deniz", "Elif", "Ferhat", "Gizem", "Hakan", "Irmak", "Kaan", "Leyla", "Murat", "Nazan", "Okan", "Pelin", "Selim"],
    "de_DE": ["Anke", "Bernd", "Clara", "Dieter", "Emma", "Fritz", "Greta", "Heiko", "Ines", "Jonas", "Karla", "Lukas", "Meike", "Norbert", "Petra", "Rainer"],
    "fr_FR": ["Agathe", "Bastien", "Chloé", "Denis", "Élise", "Fabien", "Gaëlle", "Hugo", "Inès", "Jules", "Katia", "Luc", "Margot", "Noé", "Odile", "Pascal"],
}
LAST = {
    "en_US": ["Abbott", "Barlow", "Crane", "Dalton", "Easton", "Fletcher", "Granger", "Hobbs", "Ingram", "Jarvis", "Keller", "Lowell", "Mercer", "Norwood", "Osborn", "Prescott", "Rowland", "Sutton", "Thorne", "Whitaker"],
    "tr_TR": ["Aksoy", "Bilgin", "Coşkun", "Doğan", "Erdem", "Güneş", "Işık", "Kaplan", "Keskin", "Korkmaz", "Özkan", "Polat", "Sezer", "Tekin", "Uysal", "Yavuz"],
    "de_DE": ["Albrecht", "Brandt", "Conrad", "Dietz", "Engel", "Falk", "Graf", "Hartmann", "Jansen", "Keller", "Lorenz", "Maurer", "Naumann", "Pohl", "Reuter", "Seidel"],
    "fr_FR": ["Aubert", "Besson", "Chevalier", "Delmas", "Étienne", "Faure", "Gaillard", "Humbert", "Jacquet", "Lambert", "Maillard", "Noël", "Perrot", "Renaud", "Sabatier", "Vasseur"],
}
CITY = {
    "en_US": ["Ashford", "Brookdale", "Cedarville", "Dunmore", "Eastfield", "Fairmont", "Glenwood", "Harborview", "Lakeside", "Millbrook", "Northgate", "Oakridge"],
    "tr_TR": ["Adana", "Bursa", "Denizli", "Edirne", "Konya", "Mersin", "Ordu", "Rize", "Samsun", "Sivas", "Trabzon", "Van"],
    "de_DE": ["Aachen", "Bremen", "Coburg", "Dresden", "Erfurt", "Freiburg", "Gera", "Hagen", "Jena", "Kassel", "Mainz", "Ulm"],
    "fr_FR": ["Angers", "Brest", "Caen", "Dijon", "Grenoble", "Lille", "Metz", "Nantes", "Orléans", "Pau", "Reims", "Tours"],
}
STREET = {
    "en_US": ["Birch Street", "Canal Road", "Elm Avenue", "Garden Lane", "Hill Drive", "Maple Street", "Park Avenue", "River Road", "Station Street", "Willow Court"],
    "tr_TR": ["Bahar Sokak", "Çınar Caddesi", "Deniz Sokak", "Gül Sokak", "İnci Caddesi", "Lale Sokak", "Park Caddesi", "Zafer Caddesi"],
    "de_DE": ["Ahornweg", "Bachstraße", "Feldweg", "Gartenstraße", "Hauptstraße", "Lindenallee", "Parkstraße", "Schulweg"],
    "fr_FR": ["rue des Acacias", "rue du Canal", "avenue de la Gare", "place du Marché", "rue du Moulin", "rue Neuve", "rue des Vignes", "quai du Port"],
}
COUNTRY = ["Argentina", "Australia", "Brazil", "Canada", "Chile", "Egypt", "France", "Germany", "India", "Italy", "Japan", "Kenya", "Mexico", "Norway", "Peru", "Poland", "Spain", "Türkiye", "United States", "Vietnam"]
COMPANY = ["Ltd", "Group", "Partners", "and Sons", "Holdings", "Works"]
JOB = ["Accountant", "Architect", "Baker", "Carpenter", "Chemist", "Designer", "Editor", "Electrician", "Engineer", "Gardener", "Librarian", "Mechanic", "Nurse", "Pilot", "Teacher", "Translator"]
WORD = ["amber", "bridge", "cloud", "drift", "ember", "field", "glass", "harbor", "island", "juniper", "kettle", "lantern", "meadow", "north", "orbit", "pebble", "quartz", "ripple", "signal", "timber", "upland", "velvet", "window", "yonder"]
DOMAIN = ["example.com", "example.net", "example.org"]
#: Country code and length of the numeric part of account numbers.
IBAN = {"en_US": ("GB", 18), "tr_TR": ("TR", 22), "de_DE": ("DE", 18), "fr_FR": ("FR", 23)}


class Maker:
    """Makes synthetic columns for one value; each part draws with a nonce of its own."""

    def __init__(self, prefix: str, value: Column, locale: str):
        self.prefix, self.value, self.locale = prefix, value, locale if locale in FIRST else "en_US"

    def bits(self, nonce: str) -> Column:
        return draw(self.prefix, self.value, nonce)

    def number(self, nonce: str, low: int, high: int) -> Column:
        return draw_int(self.bits(nonce), low, high).cast("string")

    def padded(self, nonce: str, digits: int) -> Column:
        return F.lpad(self.number(nonce, 0, 10**digits - 1), digits, "0")

    def first(self) -> Column:
        return pick(self.bits("first"), FIRST[self.locale])

    def last(self) -> Column:
        return pick(self.bits("last"), LAST[self.locale])

    def name(self) -> Column:
        return F.concat_ws(" ", self.first(), self.last())

    def user(self) -> Column:
        plain = lambda c: F.regexp_replace(F.lower(F.translate(c, "ÇĞİÖŞÜÉËÈçğışöüéëèßïô", "CGIOSUEEEcgisoueeesio")), "[^a-z]", "")
        return F.concat(plain(self.first()), F.lit("."), plain(self.last()), self.number("user", 1, 999))

    def city(self) -> Column:
        return pick(self.bits("city"), CITY[self.locale])

    def street(self) -> Column:
        return F.concat_ws(" ", self.number("house", 1, 400), pick(self.bits("street"), STREET[self.locale]))

    def postcode(self) -> Column:
        return self.padded("postcode", 5)

    def address(self) -> Column:
        return F.concat(self.street(), F.lit(", "), self.postcode(), F.lit(" "), self.city())

    def phone(self) -> Column:
        return F.concat(F.lit("+1-555-"), self.padded("phone1", 3), F.lit("-"), self.padded("phone2", 4))

    def card(self) -> Column:
        body = F.concat(F.lit("4"), self.padded("card1", 7), self.padded("card2", 7))
        return F.concat(body, luhn_check_digit(body))

    def ssn(self) -> Column:
        return F.concat(F.lpad(self.number("ssn1", 1, 665), 3, "0"), F.lit("-"), F.lpad(self.number("ssn2", 1, 99), 2, "0"), F.lit("-"), F.lpad(self.number("ssn3", 1, 9999), 4, "0"))

    def iban(self) -> Column:
        country, size = IBAN[self.locale]
        body = F.concat(*[self.padded(f"iban{i}", min(9, size - i)) for i in range(0, size, 9)])
        check = 98 - mod97(F.concat(body, F.lit(country), F.lit("00")))
        return F.concat(F.lit(country), F.lpad(check.cast("string"), 2, "0"), body)

    def ipv4(self) -> Column:
        return F.concat_ws(".", self.number("ip1", 1, 223), *[self.number(f"ip{i}", 0, 255) for i in (2, 3)], self.number("ip4", 1, 254))

    def ipv6(self) -> Column:
        return F.concat_ws(":", *[F.lower(F.lpad(F.hex(draw_int(self.bits(f"six{i}"), 0, 65535)), 4, "0")) for i in range(8)])

    def words(self, nonce: str, n: int) -> Column:
        return F.concat_ws(" ", *[pick(self.bits(f"{nonce}{i}"), WORD) for i in range(n)])

    def sentence(self, nonce: str = "w") -> Column:
        return F.concat(F.initcap(pick(self.bits(f"{nonce}0"), WORD)), F.lit(" "), self.words(f"{nonce}x", 5), F.lit("."))

    def date(self, nonce: str, first_year: int, last_year: int) -> Column:
        days = draw_int(self.bits(nonce), 0, (last_year - first_year + 1) * 365 - 1)
        return F.date_format(F.date_add(F.lit(f"{first_year}-01-01").cast("date"), days.cast("int")), "yyyy-MM-dd")


#: Provider names, with the other names under which each is known.
PROVIDERS: dict[str, Callable[[Maker], Column]] = {}


def _provide(names: str, make: Callable[[Maker], Column]) -> None:
    for name in names.split():
        PROVIDERS[name] = make


_provide("email safe_email company_email", lambda m: F.concat(m.user(), F.lit("@"), pick(m.bits("domain"), DOMAIN)))
_provide("name full_name", Maker.name)
_provide("first_name firstname", Maker.first)
_provide("last_name lastname surname", Maker.last)
_provide("phone phone_number mobile", Maker.phone)
_provide("address full_address", Maker.address)
_provide("street street_address", Maker.street)
_provide("city", Maker.city)
_provide("country", lambda m: pick(m.bits("country"), COUNTRY))
_provide("postcode zipcode zip", Maker.postcode)
_provide("company company_name", lambda m: F.concat_ws(" ", m.last(), pick(m.bits("company"), COMPANY)))
_provide("job occupation", lambda m: pick(m.bits("job"), JOB))
_provide("credit_card credit_card_number cc", Maker.card)
_provide("ssn", Maker.ssn)
_provide("iban", Maker.iban)
_provide("ipv4 ip", Maker.ipv4)
_provide("ipv6", Maker.ipv6)
_provide("user_name username", Maker.user)
_provide("url website", lambda m: F.concat(F.lit("https://"), m.words("url", 1), F.lit("."), pick(m.bits("domain"), DOMAIN), F.lit("/")))
_provide("text sentence", Maker.sentence)
_provide("paragraph", lambda m: F.concat_ws(" ", *[m.sentence(f"p{i}") for i in range(3)]))
_provide("date_of_birth dob", lambda m: m.date("dob", 1940, 2005))
_provide("date_this_century date", lambda m: m.date("date", 2000, 2024))
_provide("word", lambda m: m.words("word", 1))


def synthetic(prefix: str, value: Column, provider: str, locale: str) -> Column:
    """A value of the provider; an unknown one is an error."""
    name = provider.lower().strip()
    if name not in PROVIDERS:
        raise ValueError(f"there is no provider {provider}; there are {', '.join(sorted(PROVIDERS))}")
    return PROVIDERS[name](Maker(prefix, value, locale))
