"""A small labelled table for the tagger of personal data, built by rule from sentences with slots.

``{person}``, ``{email}``, ``{phone}``, ``{id_number}`` and ``{address}`` are filled with invented values and labelled;
``{n}``, ``{Name}``, ``{noun}`` and the like are filled with words that carry no label. Surnames, towns, roads, hosts and
product names are put together from syllables, so the field can learn no list of them, and the sentences speak of
gardens, kitchens, clubs and offices: nothing here is taken from the texts that are tagged.
"""

from __future__ import annotations

import random
import re

from siltline.llm.pairs import SMALL_WORDS

# Common given names of several languages.
GIVEN = (
    "Adam Agnieszka Ahmed Aiko Aisha Alejandro Alexander Ali Alice Amina Amir Ana Anders Andrea Andrei Andrew Angela Anita Anjali Anna Anneke Anton Antonio Arthur Astrid Ayşe Barbara Beatriz Benjamin Benoît Bernd Björn Bogdan Bruno Callum Camille Carla Carlos Carmen "
    "Charlotte Chiara Chloé Christian Christine Clara Claire Daan Daniel Dario David Deepak Diana Diego Dieter Dmitri Eduardo Elena Elif Elisabeth Emily Emma Eric Eva Farah Fatima Felix Fernando Francesca Francisco Frank Franz Freya Gabriel George Giovanni Giulia Goran "
    "Grace Greta Hanna Hans Haruto Hassan Heinz Helen Henrik Henry Hiroshi Hugo Ibrahim Ida Igor Ines Ingrid Irina Isabel Ivan James Jan Jane Javier Jean Jelena Jennifer Joaquim João Johan John Jonas Jorge José Juan Julia Jürgen Karin Karl Katarina Kenji Kevin Khaled "
    "Klaus Kofi Kwame Lars Laura Léa Leila Lena Linda Linh Linnea Lotte Luca Lucas Lucía Luis Magdalena Manuel Marco Marek Margaret Maria Mark Marta Martin Mary Mateo Matteo Mehmet Mei Mette Michael Miguel Milan Mohammed Monika Nadia Natalia Nicolas Niels Nikolai Noah Noor Nora "
    "Olga Oliver Olivia Omar Oskar Pablo Paolo Patricia Paul Pavel Pedro Peter Pierre Piotr Priya Rachel Raj Rashid Ravi Ricardo Robert Rosa Ruth Sandra Sanne Sara Sergei Silvia Simon Sofia Sophie Stefan Susan Sven Svetlana Thomas Tomasz Vera Victor Wei Willem William Yuki Yusuf Zeynep"
).split()
# Names of public products, which name no person.
PRODUCTS = "Azure Synapse|Power BI|Apache Kafka|Kafka Connect|Delta Lake|Unity Catalog|Structured Streaming|Google Cloud|Visual Studio|Red Hat|Elastic Search|Looker Studio|Power Query|Great Expectations|Event Hubs|Auto Loader|Data Factory|Azure Data Factory|Amazon Redshift|Apache Spark|Apache Flink|Apache Beam|Oracle Cloud|Microsoft Teams|Adobe Acrobat|Jupyter Notebook|Grafana|Postgres|Snowflake|Databricks|Kubernetes|Docker|Terraform|Airflow|BigQuery|PySpark|Jenkins|Tableau|Cassandra|Redis|Debezium|Iceberg|Trino|Avro|Parquet|dbt".split("|")
# Some common family names.
FAMILY = "Smith Jones Taylor Brown Wilson Evans Walker Wright Murphy Kelly Müller Schmidt Schneider Fischer Weber Wagner Becker Hoffmann García Fernández López Martínez Sánchez Rossi Russo Ferrari Bianchi Silva Santos Oliveira Pereira Jansen Bakker Visser Dubois Moreau Laurent Lefebvre Nguyen Tran Kim Park Chen Wang Singh Patel Kowalski Nowak Ivanov Petrov Hansen Olsen Johansson Andersson Yılmaz Kaya Haddad Okafor Mensah Tanaka Suzuki".split()
# Syllables of invented words.
_ONSETS = "b bl br c ch cr d dr f fl g gl gr h j k kl kr l m n p pl pr r s sch sh sl sp st t th tr v w z".split()
_VOWELS = "a e i o u ai ea ee ie oo ou au".split() + list("aeiou") * 4
_CODAS = ["", "", "", "", "l", "n", "r", "s", "t", "m", "k", "ng", "rd", "ck", "nt", "ll", "rn", "lm"]
_TAILS = ["son", "sen", "man", "berg", "feld", "hof", "stein", "well", "worth", "wood", "by", "sky", "escu", "idis", "ov", "in", "ez", "elli", "ard", "eau", "ström", "gård", "ham", "low"]
# Ordinary words for names of things and for what stands around a piece.
_NOUNS = "garden oven ladder bicycle violin kettle harbour museum library bakery orchard recipe ticket carpet lantern tractor saddle piano engine camera blanket window basket hammer mirror pencil fountain stadium theatre museum clinic ferry tunnel bridge market festival concert journal album calendar planner tracker viewer browser compiler printer scanner router monitor keyboard speaker".split()
_QUALITIES = "Green Silent Golden Rapid Simple Northern Central Modern Bright Hidden Double Open Smart Grand Royal Happy Deep Little Global First".split()
_PLURALS = ["broken tiles", "long queues", "dry seeds", "loose screws", "missing keys", "cold rooms", "late trains", "double bookings", "torn pages", "flat tyres", "burnt crusts", "noisy fans"]
_GROUPS = ["the choir", "our garden club", "the night shift", "three apprentices", "a new tenant", "the annual report", "every visitor", "the kitchen crew", "the front office", "a distant cousin", "the school board", "our landlord"]
_WORDS = "please the and with from before after because again never today soon about this that later still always only maybe then when where which und der nicht mit für bitte danach pour avec les dans merci encore para con por favor luego também depois con per grazie dopo met voor daarna".split()

# Endings of ordinary words, by language; invented words with them stand for the words of prose.
_ENDINGS = {
    "en": "ing ed tion tions ment ments ness ity ous able ive al er ers ly ism ies s es ful less ance".split(), "de": "ung ungen keit heit lich isch ig en er te ten ieren barkeit schaft los".split(), "fr": "tion tions ment ité eux euse able er ée ées ant age isme".split(),
    "es": "ción ciones mente dad ado ados ando oso able ar ero ismo".split(), "pt": "ção ções mente dade ado ados ando oso vel ar eiro".split(), "it": "zione zioni mente tà ato ati ando oso bile are iere ismo".split(), "nl": "ing ingen heid lijk isch en er te ten baar schap".split(),
}
# Ordinary words that often open a sentence or stand before a noun.
_OPEN = "Good Great Bad Old New Many Some Most Both Small Large Clean Plain Slow Fast Late Early Long Short Every Each Any Only Even Still Never Always Before After During Between Without Within Reading Writing Loading Saving Testing Checking Running Using Counting Sorting Remember Note Tip Reminder Summary Result Lesson Example Question Answer Warning Today Tomorrow Yesterday Honestly Clearly Finally".split()
_SIGNS = [".", ".", ".", ".", "?", "!", ":", "…"]

# English kinds of street stand behind the name, the others before it or within the word.
_STREETS = "Street Road Lane Avenue Drive Court Close Terrace Way Square Place Crescent Row Hill Gardens Park Mews Walk Boulevard Parkway".split()
_STRASSEN = ["straße", "strasse", "str.", "gasse", "weg", "platz", "allee", "ring", "damm", "ufer", "steig", "hof"]
_RUES = ["rue", "avenue", "boulevard", "place", "chemin", "allée", "impasse", "quai", "cours", "route", "square"]
_CALLES = ["Calle", "Avenida", "Plaza", "Paseo", "Camino", "Ronda", "Travesía", "Carrera", "Rua", "Praça", "Largo", "Via", "Piazza", "Corso", "Viale", "Vicolo"]
_STRATEN = ["straat", "laan", "kade", "plein", "dijk", "steeg", "singel"]

SENTENCES = {
    "person": [
        "{person} baked the bread for {group}.", "We met {person} at the harbour.", "My neighbour {person} repairs every {noun}.", "The prize went to {person} and {person}.", "{person} sings in {group} on Tuesdays.", "Dr. {person} examined the {noun}.", "Tickets are sold by {person} at the door.",
        "Has {person} paid for the {noun}?", "Yesterday {person} told us about {plural}.", "A letter from {person} arrived for {group}.", "Photos: {person}", "Editor: {person}.", "Dear {person}, the {noun} is ready.", "Kind regards, {person}", "Mrs {person} rented the {Name} for {n} days.", "Prof. {person} will speak about {plural}.",
        "{person} thinks that {plural} are worse than {plural}.", "If the {noun} leaks, {person} knows what to do.", "Thank {person} for the cake!", "Well done {person} for winning the race.", "As {person} said at dinner, the {noun} is old.", "In the words of {person}, gardens need time.", "{person} and {group} painted the fence.", "Please greet {person} from me.",
        "Herr {person} hat den Schlüssel abgegeben.", "Wir danken {person} für den Kuchen.", "Laut {person} regnet es morgen.", "Madame {person} a fermé la porte.", "Un grand bravo à {person} pour le concert.", "D'après {person}, le marché ouvre tôt.", "La señora {person} compró {n} entradas.", "Según {person}, el pan está listo.", "Felicidades a {person} por el premio.", "O senhor {person} abriu a loja.", "Parabéns a {person} pela festa.",
        "La maestra {person} ha chiuso il museo.", "Complimenti a {person} per la torta.", "Mevrouw {person} heeft de sleutel.", "Met dank aan {person} voor de bloemen.", "I was driven home by {person} last night.", "I never agreed with {person} about the {noun}.", "When the lights went out, {person} was in the cellar.", "{person} lost {n} games in a row.", "{person} never liked {plural}.", "Nobody but {person} has the key, {n} people asked.", "Speak with {person} about the rent.", "{person}, who runs {group}, retired.", "Minutes taken by {person}", "According to the caretaker {person}, {plural} are normal.", "{person}: the {noun} was mine.", "{person} and I {verb} the {noun}.", "{person} and I {verb} about it.", "{person} and we {verb} {n} {plural}.", "{Group} and {person} {verb} it.", "{Group} and {person} {verb} the {noun} together.", "The lecture by {person} was about {plural}.", "{person} {verb} the {noun}.", "{person} {verb} the {noun} in {Name}.", "I was taught by {person} last year.", "{person} said that {plural} matter more.",
    ],
    "email": [
        "Orders for cakes: {email}", "Please confirm your seat via {email} by noon.", "The landlord answers at {email} only.", "{email} is the box of {group}.", "You can reach the choir through {email}.", "Lost something? {email}!", "Tickets ({email}) are free for children.", "Someone at {email} sold me a {noun}.", "Recipes may be sent to {email} or {email}.",
        "Bitte an {email} melden.", "Anmeldung unter {email} bis Montag.", "Merci de répondre à {email} avant midi.", "Inscripciones en {email} hasta el lunes.", "Reservas: {email}, obrigado.", "Scrivete a {email} per i biglietti.", "Mail naar {email} voor een plek.", "From: {email}", "{email}", "E-mail {email}", "Parents who want a {noun} should use {email} until May.", "Forward the bill to {email} and I will pay it.", "Her box {email} is full.", "Reply to {email}, not to {group}.", "Hints about {plural} go to {email}, thanks.", "Applications are read at {email}.",
    ],
    "phone": [
        "Taxi: {phone}", "The bakery takes orders on {phone}.", "Dial {phone} for the night desk.", "In an emergency ring {phone} at once.", "Our plumber ({phone}) comes on Sundays.", "Text the coach at {phone} when it rains.", "{phone} is the number of {group}.", "The old line {phone} was cut off.", "Tel {phone}", "Mobile: {phone}", "Fax: {phone}.", "Booking line {phone}, weekdays only.",
        "Bitte {phone} wählen.", "Notruf der Hausverwaltung: {phone}", "Telefon {phone} ab neun Uhr.", "Téléphonez au {phone} avant midi.", "Numéro du club : {phone}.", "Teléfono {phone}, preguntar por el jardín.", "Marque el {phone} para reservar.", "Telefone: {phone}.", "Chiamate il {phone} dopo pranzo.", "Bel {phone} voor een taxi.", "You can get me on {phone} after six.", "Cell {phone} or office {phone}.", "Leave a message under {phone} if the {noun} breaks.", "Reception says {phone} is always busy.", "Message {phone} when you arrive.", "The driver's number is {phone}, he speaks Dutch.",
    ],
    "id_number": [
        "The passport {id_number} was found in the park.", "Identity card {id_number} lies at the lost property office.", "Social security number {id_number} must not be shown to {group}.", "The clerk read out tax number {id_number} aloud.", "ID: {id_number}", "Insurance no. {id_number} belongs to a tenant.", "Her driving document shows {id_number}, which is private.", "Personalausweis {id_number} wurde gefunden.", "Reisepass {id_number} ist abgelaufen.", "Sozialversicherungsnummer: {id_number}", "Steuernummer {id_number} bitte schwärzen.",
        "Passeport {id_number} perdu à la gare.", "Numéro fiscal {id_number} sur la facture.", "Pasaporte {id_number} olvidado en el hotel.", "Documento de identidad {id_number} sin firma.", "NIF {id_number} en el recibo.", "Cartão de cidadão {id_number} encontrado.", "Codice fiscale {id_number} da cancellare.", "Paspoort {id_number} is verlopen.", "National identity number {id_number} stands on the badge.", "The tenant's insurance number is {id_number}.", "A scan with passport number {id_number} hung on the wall.", "Visitors wrote {id_number} as their identity document.", "Tax document {id_number} was thrown away by accident.", "On the form you still read social insurance or passport number {id_number}.",
    ],
    "address": [
        "The piano goes to {address} on Monday.", "Our shop moved to {address}.", "He has lived at {address} since spring.", "Deliver the plants to {address}, please.", "Party at my flat, {address}, from eight.", "{address} is where the choir meets.", "Find us here: {address}", "Bakery: {address}", "The taxi waits outside {address}.", "Letters were returned from {address} unopened.", "She works at {address} now.", "A fire broke out in {address} last night.", "Wir treffen uns in der {address}.", "Anschrift: {address}", "Das Paket ging an {address} zurück.", "Ich wohne jetzt {address}.", "Le magasin est au {address}.", "Adresse du club : {address}.", "Elle loue {address} cette année.", "La tienda está en {address}.", "Mi casa, {address}, tiene jardín.", "Dirección: {address}", "A festa é na {address}.", "Il negozio si trova in {address}.", "Wij wonen in {address} sinds kort.", "Pick up the {noun} at {address}.", "Post the keys to {address} by Friday.", "I rent a room at {address} these months.", "Address: {address}.", "Come to {address} for lunch.",
    ],
    "": [
        "The oven heats to {n} degrees in {n} minutes.", "Parcel {four}-{n}-{four} reached shelf {n}.", "Parcel {long}-{n}-{four} had the label 20{n} on every side.", "Receipt {long} and voucher number {four}-{four} were printed.", "Print run {long}-{four}-{four} took {n} hours on the {Name}.", "Bus {four} stops at platform {n} on {date}.", "The bill was {big} euros for {n} kilos, due on {date}.", "Seal {hex} did not fit the crate from 192.168.{n}.{n}.", "Form GX-{four} follows release 2.{n}.{n}: the {Name}.", "Log in as guest@desk-{n}, not as owner@till-{n}.", "Robots svc-cook@oven-{n} and bot@shelf-{n} work at night.", "Follow @{host} or open https://www.{host}.example/menu/{long} for the menu.", "Photos: https://img.{host}.example/a/{four}", "The backup goes to ftp://box-{n}/photos/{date}/{four}.", "Between Friday and now the queue fell from {big} to {n} people.", "{big} visitors came in {n} days.", "Edition 20{n}.{n}.{n} of guide ab-{n}.internal.example is out.", "Use a4 paper, b2 posters and mp3 files.", "Only k2 and m4 screws fit; the x64 model needs utf16 labels.", "Check md5 sums and port 80{n} first.", "Serial {hex} is on the box.", "Order {four}-{n}-{four} is late.", "Order {long}-{n}-{four} waits in aisle {n}.", "Order {long}-{n}-{n} was split.", "Your order {four}-{n}-{long} has shipped.", "Order {four}-{n}-{n}, part {n}.", "Ticket {four}-{n}-{four} is closed.", "Ticket {long} is open, ticket AB-{four} too.", "Build {long}-{four}-{four} is green.", "Build {long}-{four}-{four} broke {n} tests.", "The build {long}-{four} took longer than build {long}-{four}.", "Invoice {four}-{n}-{four} of {date} is unpaid.", "Case {long}-{n}-{four} was closed with code {four}.", "Batch {four} {n} {four} is sold out.", "Platform 9 and {four} seats, row {n}.",
        "The {Name} sells {plural}.", "{Name} and {Name} opened in May.", "With {Name} nobody needs a {noun}.", "We compared {Name} with {Name} on {big} tickets.", "In {Name} the {noun} turns once a day.", "With {Name} the {noun} needs {n} minutes and {n} without it.", "{Name} keeps the {noun} clean.", "Buy {Name} or {Name3}, not both.", "{Name3} is a {noun} for {group}.", "Ask {group} about the {noun}.", "According to {group}, {plural} are rare.", "{Group} asked why {plural} cost so much.", "{Plural} and {plural}, a {noun}: choose two.", "My uncle says that a {noun} without a lid is only half a {noun}.", "Some suspected {Name}, others the {noun} or {plural}.", "Compared with {Name}, our old {noun} in {Name} used {n} more litres.", "{Group} likes {Name}, while {group} swears by {Name}.", "When {Name} closed, {group} cried for {n} hours.", "According to {Name}, summer starts early.", "Cheers to {group} for {n} goals!", "Special offer: {Name}.", "{Name} never worked with {Name}.",
        "CHAPTER {n}: {UPPER}", "{UPPER} HANDBOOK, PART {n}", "{Name} Course Notes, Part {n}", "{Name} course notes, part {n} |", "~ {Name} course notes, part {n} ~", "{n}   {UPPER} COURSE NOTES, PART {n}", "{Name} Course Notes, Part {n}   {n}", "Unit {n}: {Title}", "Unit {n}: off-season {noun}", "~ Practical {Name} for {group} ~", "Practical {Name} For {TitleGroup}", "PRACTICAL {UPPER} FOR {UPPERGROUP}", "EVENING CLASS: COSTS AND {UPPERPLURAL}", "EVENING   CLASS:   TIME   AND   {UPPERPLURAL}", "Evening Class: Costs And {TitlePlural}", "Evening class: costs and {plural}", "Evening Class: Quiet Rooms And {TitlePlural}", "Page {n} of {n}", "{n}/{n}", "[{n}]", "— {n} —", "x {n}", "{n}.{n} GB", "{n} % of {n} guests", "Row {n}, Seat {n}", "Stage {n}: check the {noun}", "{n}. {Group} checked the {noun}.", "Why {plural} matter", "How a {noun} saved the day", "The {noun} owner's guide", "#gardening #baking #{noun}",
        "UPDATE shelves SET row = {n} WHERE id = {four}", "SELECT name, min(day) FROM guests GROUP BY name", "table.sort_values('{noun}', limit={n})", "DROP TABLE {noun}s", "DELETE FROM {noun}s WHERE age > {n}", "@cached", "config.set('{noun}.size', {n})", "import {noun}_{noun} as {noun}", "The {noun} shut {n} minutes early since {plural} turned up in the second act.", "Guests wanted to hear how {Name} deals with {plural} when the {noun} stops.", "Mirrors replaced {n} lamps in the {noun}.", "After the storm we repaired the {noun} and saw that {plural} had caused the flood.", "It sounds odd, yet sweeping the {noun} clearly pleased {group}.", "{Name} can do this in one go, but the {noun} stays tidy with two.", "With {big} cars a day the {noun} spends its life on {plural}.", "Did I forget anything?", "Try again.", "A rule of thumb: whenever {plural} meet {plural}, the {noun} loses.", "Keep {n} copies of the {noun}, so that going back takes {n} seconds.",
        "Der Ofen braucht jetzt {n} Minuten, weil wir vorher die Bleche reinigen.", "Gestern hat {group} bemerkt, dass der Zug wegen {n} Kühen hielt.", "Nach dem Umzug zu {Name} sind kalte Räume seltener.", "Am schönsten finden wir die Übersicht, auch wenn der Verein das anders sieht.", "Zum Glück hatte die Nachbarin schon gegossen.", "Ohne {Name} nützt der beste Garten nichts.", "Die Gemeinde wollte wissen, warum der Markt {big} Besucher verlor.", "Hier stehen Tisch, Stuhl und Lampe.", "Nous avons appris hier que le train partait après {n} minutes.", "Cela semble simple, mais le chœur n'avait jamais compté les chaises.", "Depuis le passage à {Name}, les files sont plus courtes.", "Le Petit Marché ouvre à neuf heures.", "Ayer vimos que la puerta cerraba después de {n} minutos.", "Desde que usamos {Name}, las colas son más cortas.", "El vecino quería saber por qué faltaban {big} flores.", "Parece fácil, mas o coro nunca contou as cadeiras.", "Ontem a padaria fechou depois de {n} minutos.", "Sembra facile, ma il coro non ha mai contato le sedie.", "Da quando usiamo {Name}, le code sono più corte.", "Gisteren zagen we dat de deur na {n} minuten dichtging.", "Sinds {Name} zijn de rijen korter.",
    ],
}


def word(r: random.Random, syllables: int | None = None) -> str:
    """An invented word in lower case."""
    return "".join(r.choice(_ONSETS) + r.choice(_VOWELS) + r.choice(_CODAS) for _ in range(syllables or r.choice([1, 2, 2, 2, 3])))


def surname(r: random.Random) -> str:
    k = r.random()
    if k < 0.2:
        return r.choice(FAMILY)
    return (word(r, r.choice([1, 1, 2])) + (r.choice(_TAILS) if k < 0.65 else word(r, 1))).capitalize()


def given_name(r: random.Random) -> str:
    """A common given name, or an invented one, so that names are known by their place too."""
    return r.choice(GIVEN) if r.random() < 0.7 else (word(r, r.choice([1, 1, 2])) + r.choice(["a", "e", "o", "ia", "í", "el", "ur", "ina", "us"])).capitalize()


def person(r: random.Random) -> str:
    g, s, k = given_name(r), surname(r), r.random()
    if k < 0.1:
        return f"{g[0]}. {s}"
    if k < 0.17:
        return f"{s}, {g}"
    if k < 0.22:
        return f"{g} {r.choice('ABCDEFGHJKLMNPRSTV')}. {s}"
    if k < 0.28:
        return f"{g} {s}-{surname(r)}"
    if k < 0.34:
        return f"{g} {r.choice(['van', 'van', 'de', 'von', 'de la', 'di', 'da', 'van der', 'ter', 'bin', 'del'])} {s}"
    if k < 0.39:
        return f"{g} {r.choice(['al-', 'O’', chr(79) + chr(39), 'Mc', 'D’'])}{s}"
    if k < 0.45:  # in lower case only a known given name can be told from other words
        return f"{r.choice(GIVEN)} {s}".lower()
    if k < 0.51:
        return f"{g} {s}".upper()
    return f"{g} {s}"


def email(r: random.Random) -> str:
    g, s, n = re.sub(r"[^a-z]", "", given_name(r).lower()) or "jo", re.sub(r"[^a-z]", "", surname(r).lower()) or "doe", r.randint(1, 99)
    user = r.choice([f"{g}.{s}", f"{g}_{s}", f"{g[0]}{s}", f"{s}{n}", f"{g}+{word(r, 1)}", f"{s}.{g}.{n}", f"{s}.{g}", f"{g}{s}", f"{g}", f"{g}-{s}", word(r)])
    h = word(r)
    host = r.choice([f"{h}.example", f"{h}.test", "example.org", "example.net", "example.com", f"mail.{h}.example", f"{word(r, 1)}.{h}.org", f"{h}.example.com", f"{h}.com", f"{h}.de", f"{h}.co.uk", f"{h}-{word(r, 1)}.fr", f"{h}.io"])
    k = r.random()
    if k < 0.1:
        return f"{user.replace('.', ' dot ') if r.random() < 0.5 else user} at {host.replace('.', ' dot ')}"
    if k < 0.18:
        return f"{user.replace('.', ' (dot) ') if r.random() < 0.3 else user} (at) {host.replace('.', ' (dot) ')}"
    if k < 0.26:
        return f"{user} [at] {host}"
    return f"{user}@{host}".upper() if k < 0.34 else f"{user}@{host}"


def digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def phone(r: random.Random) -> str:
    d = lambda n: digits(r, n)
    a, c = r.choice("23456789") + d(2), r.choice(["1", "31", "33", "34", "39", "44", "48", "49", "351", "46"])
    out = r.choice([
        f"+{c} {d(2)} {d(5)} {d(3)}", f"+49 (0){d(2)} {d(5)}-{d(3)}", f"0{d(2)}/{d(8)}", f"00{c} {d(3)} {d(2)} {d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0{d(1)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", f"{a}-{d(3)}-{d(4)}", f"({a}) {d(3)}-{d(4)}", f"{a}.{d(3)}.{d(4)}",
        f"{a} {d(3)} {d(4)}", f"+1{a}{d(7)}", f"+1 {a} {d(3)} {d(4)}", f"07{d(3)} {d(6)}", f"+447{d(9)}", f"+44 7{d(3)} {d(6)}", f"+34 6{d(2)} {d(3)} {d(3)}", f"0{d(3)} {d(6)}", f"+39 0{d(1)} {d(4)} {d(4)}", f"+1-{a}-{d(3)}-{d(4)}", f"(0{d(2)}) {d(7)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}",
    ])
    return out + r.choice([f" ext. {d(2)}", f" x{d(3)}", f" ext {d(3)}"]) if r.random() < 0.15 else out


def id_number(r: random.Random) -> str:
    d = lambda n: digits(r, n)
    u = lambda: r.choice("ABCDEFGHJKLMNPQRSTVXYZ")
    return r.choice([
        f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}", d(9), f"{u()}{u()}{d(6)}{r.choice('ABCD')}", f"{u()}{u()} {d(2)} {d(2)} {d(2)} {r.choice('ABCD')}", f"{r.choice('XYZ')}{d(7)}{u()}", f"{d(8)}-{u()}", f"{d(8)}{u()}", f"{u()}{d(8)}", f"{u()}{u()}{d(7)}",
        f"{r.choice('0123')} {d(2)} {d(2)} {d(2)} {d(3)} {d(3)} {d(2)}", f"{d(2)} {d(3)} {d(3)} {d(3)}",
    ])


def address(r: random.Random) -> str:
    n, z, town, k = r.randint(1, 240), digits(r, 5), (word(r, 2) + r.choice(["", "", "ton", "burg", "ville", "haven", "dorf"])).capitalize(), r.random()
    if r.random() < 0.2:
        town = r.choice(["Bad", "Port", "New", "Saint", "San", "East"]) + " " + town
    name = word(r).capitalize() if r.random() < 0.7 else r.choice([*_QUALITIES, *map(str.capitalize, _NOUNS)])
    if r.random() < 0.3:
        name = r.choice(["Old", "Upper", "Great", "King", "Saint"]) + " " + name
    if k < 0.4:
        road = f"{name} {r.choice(_STREETS)}"
        return r.choice([f"{n} {road}, {town} {z}", f"{n}{r.choice('ABC')} {road}, {town}", f"Flat {n % 40 + 1}, {n} {road}", f"{n} {road}, {town}", f"{n} {road}", f"Apt {n % 40 + 1}, {n} {road}, {town} {z}", f"Unit {n % 40 + 1}, {n} {road}, {town}"])
    if k < 0.6:
        w = word(r).capitalize()
        road = r.choice([w + r.choice(_STRASSEN), f"{w}er Straße", f"{r.choice(['Am', 'An der', 'Zum', 'Im', 'Auf dem', 'Unter den'])} {name}", f"{w}-{word(r).capitalize()}-Straße", w + r.choice(_STRATEN)])
        return r.choice([f"{road} {n}, {z} {town}", f"{road} {n}{r.choice('abc')}", f"{road} {n}"])
    if k < 0.8:
        words = [w.capitalize() for w in (word(r), word(r))][: r.choice([1, 1, 2])]
        road = f"{r.choice(_RUES)} {r.choice(['de la', 'du', 'des', 'de', 'aux', ''])} {' '.join(words)}".replace("  ", " ")
        return r.choice([f"{n}, {road}, {z} {town}", f"{n} bis {road}", f"{n} ter {road}, {z} {town}", f"{n} {road}, {z} {town}", f"{n}, {road}"])
    words = [w.capitalize() for w in (word(r), word(r))][: r.choice([1, 1, 2])]
    road = f"{r.choice(_CALLES)} {r.choice(['de los', 'del', 'de la', 'de las', 'de', 'da', ''])} {' '.join(words)}".replace("  ", " ")
    return r.choice([f"{road}, {n}, {z} {town}", f"{road} {n}, {r.randint(1, 9)}º {r.choice('ABC')}", f"{road} {n}", f"{road}, {n}"])


def name(r: random.Random, words: int = 0) -> str:
    """The name of a thing: capitalised words that name no person."""
    k = words or r.choice([1, 2, 2, 2])
    if not words and r.random() < 0.3:
        return r.choice(PRODUCTS)
    if k == 1:
        return r.choice([word, term])(r).capitalize()
    first = r.choice([r.choice(_QUALITIES), term(r).capitalize(), word(r).capitalize(), r.choice(_NOUNS).capitalize(), word(r, 1).upper()])
    return " ".join([first, *(r.choice([r.choice(_NOUNS), r.choice(_NOUNS), term(r), term(r), word(r)]).capitalize() for _ in range(k - 1))])


def term(r: random.Random, language: str = "en") -> str:
    """An invented word with the ending of an ordinary one."""
    return word(r, r.choice([1, 1, 2])) + r.choice(_ENDINGS[language])


def prose(r: random.Random) -> str:
    """A sentence of small words and invented words of one language; terms may stand in capitals, as names of things do."""
    language = r.choice(["en", "en", "en", *_ENDINGS])
    small, out = SMALL_WORDS[language].split(), []
    if language == "en" and r.random() < 0.7:
        a, b, k = r.choice(_OPEN), r.choice([r.choice(_NOUNS), r.choice(_NOUNS) + "s", r.choice(_PLURALS), term(r)]), r.random()
        out.append(f"{a} {b}" if k < 0.35 else f"A {b}{r.choice(['', '', ':'])}" if k < 0.55 else f"{a} {r.randint(1, 40)},{digits(r, 3)} {b}" if k < 0.7 else f"{name(r)} and the {b}" if k < 0.8 else f"{a}: A {b}" if k < 0.9 else f"{b.capitalize()} and {r.choice(_PLURALS)}")
    for _ in range(r.randint(4, 14)):
        k = r.random()
        if k < 0.5:
            out.append(r.choice(small))
        elif k < 0.85:
            out.append(term(r, language).capitalize() if language == "de" and r.random() < 0.5 else term(r, language))
        elif k < 0.9:
            out.append(" ".join(term(r, language).capitalize() for _ in range(r.choice([1, 2, 2]))))
        elif k < 0.94:
            out.append(r.choice(["I", "We", "A", "X"]) + " " + term(r, language))
        elif k < 0.97:
            out.append(str(r.randint(1, 999)))
        else:
            out.append(f"{term(r, language)}-{term(r, language)}" + r.choice(["", ","]))
    out = " ".join(out)
    return out[0].upper() + out[1:] + r.choice(_SIGNS)


def heading(r: random.Random) -> str:
    """A title line: capitalised or upper-case words that name no person, with or without numbers."""
    words = [r.choice([name(r), f"{r.choice(_OPEN)} {r.choice(_NOUNS)}s", r.choice(_PLURALS), term(r), term(r) + "s", r.choice(_NOUNS)]) for _ in range(r.choice([1, 2, 2, 3]))]
    text = r.choice([" ", " ", " and ", ": ", " for ", ", "]).join(words)
    text = r.choice([str.title, str.title, str.upper, str.upper, str.capitalize])(text)
    n, kind = r.randint(1, 99), r.choice(["Volume", "Part", "Chapter", "No.", "Unit", "Edition", "Book"])
    text = r.choice([text, text, f"{text}, {kind} {n}", f"{kind} {n}: {text}", f"{text} {n}", f"{n}   {text}", f"The {text} Guide", f"~ {text} ~", f"{text} |", f"{text} Notes, {kind} {n}"])
    return text.replace(" ", "   ") if r.random() < 0.1 else text


_MAKE = {"person": person, "email": email, "phone": phone, "id_number": id_number, "address": address}


def labelled_texts(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts of one to four sentences with the (start, end, kind) of their pieces of personal data."""
    r = random.Random(seed)
    kinds = ["person"] * 6 + ["email"] * 3 + ["phone"] * 4 + ["id_number"] * 4 + ["address"] * 4 + [""] * 11
    fill = {
        "n": lambda: str(r.randint(1, 99)), "big": lambda: f"{r.randint(1, 40)},{digits(r, 3)}", "four": lambda: digits(r, r.choice([3, 4, 4])), "long": lambda: digits(r, r.choice([4, 5, 6, 8])), "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.randint(10, 16))),
        "date": lambda: f"202{r.randint(0, 9)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", "Name": lambda: name(r), "Name3": lambda: name(r, 3), "UPPER": lambda: name(r).upper(), "Title": lambda: f"{r.choice(_QUALITIES)} {r.choice(_NOUNS).title()}", "noun": lambda: r.choice(_NOUNS), "verb": lambda: term(r) if r.random() < 0.3 else word(r) + "ed", "plural": lambda: r.choice(_PLURALS), "Plural": lambda: r.choice(_PLURALS).capitalize(),
        "TitlePlural": lambda: r.choice(_PLURALS).title(), "UPPERPLURAL": lambda: r.choice(_PLURALS).upper(), "group": lambda: r.choice(_GROUPS), "Group": lambda: r.choice(_GROUPS).capitalize(), "TitleGroup": lambda: r.choice(_GROUPS).title(), "UPPERGROUP": lambda: r.choice(_GROUPS).upper(), "host": lambda: word(r),
    }
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.choice([1, 2, 2, 3, 4])):
            kind = r.choice(kinds)
            sentence = r.choice([prose, prose, heading])(r) if not kind and r.random() < 0.6 else r.choice(SENTENCES[kind])
            if kind and r.random() < 0.2:  # any words around the piece: its form alone must tell
                around = lambda: " ".join(r.choice(_WORDS) for _ in range(r.randint(1, 4)))
                sentence = f"{around().capitalize()} {{{kind}}}{r.choice(['', ',', ' and', ' to'])} {around()}."
            if text:
                text += r.choice([" ", " ", " ", "\n", "\n\n"])
            for part in re.split(r"(\{\w+\})", sentence):
                slot = part[1:-1] if part.startswith("{") else ""
                if slot in _MAKE:
                    value = _MAKE[slot](r)
                    spans.append((len(text), len(text) + len(value), slot))
                    text += value
                else:
                    text += fill[slot]() if slot else part
        if r.random() < 0.06:  # misread characters, as in scanned text
            text = "".join({"a": "@", "o": "0", "s": "5", "t": "+", "i": "1"}.get(c, c) if r.random() < 0.06 and not any(a <= k < b for a, b, _ in spans) else c for k, c in enumerate(text))
        out.append((text, spans))
    return out
