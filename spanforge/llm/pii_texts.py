"""Labelled texts for the personal-information model: sentences of our own with known spans.

Nothing here is taken from the tables that the model is used on: the sentences are about
offices, clinics, deliveries and clubs, and a test fails if a part of one occurs in the documents.
Names, streets, towns and mail domains are made up by rule, beside short stocks of common
names. In training, words of the frames are exchanged for words of a public tokenizer's vocabulary, so
that the model cannot learn the sentences by heart. A part of the frames, names, syllables and
streets is held out: it is never trained on and serves to measure the model on sentences and
names that it has not seen."""

from __future__ import annotations

import base64
import functools
import random
import re

from spanforge.llm.pair_defects import FUNCTION_WORDS
from spanforge.llm.tokens import TOKENIZERS

#: Chance that a word of a name, or an ordinary word, is marked as listed in the name lexicon.
LISTED_NAME, LISTED_WORD = 0.6, 0.02

_LANGS = ("en", "de", "es", "fr")
_SYLLABLES = {
    "en": "ar ber cal dor el fen gar hal is jor ken lan mor nor os per quil ros sel tam ul ven wil yor zan brook thorn ash hart pem rad cor".split(),
    "de": "an bert diet eck fried ger hild ing kar lud mar nor ott rein sieg traut ulf brand stein hof loh mann grün büch köst wend".split(),
    "es": "al be ca do es fer gon her is ju lor mar nav or pe qui ro sal tor ur val xi ye zor rre lla ño ría men".split(),
    "fr": "an beau cla do el fon gau hé is jo lou mar no or pé quin ro sau tri ur val vé yo det reau ère çon mil".split(),
}
_ENDS = {
    "en": ["", "s", "ton", "ford", "by", "more", "wick", "ley", "ham", "son", "well", "worth", "field", "ingham", "er", "y", "a"], "de": ["", "er", "mann", "ow", "hauer", "bach", "e", "a", "ke", "feld"],
    "es": ["o", "a", "ez", "ero", "ano", "ia", "", "ada", "illo"], "fr": ["", "e", "et", "eau", "ier", "ine", "ard", "ois", "elle"],
}
_STEMS = "Alder Bram Clay Dun Ember Fair Glen Heath Ivor Kirk Lark Mere North Otter Pine Quarry Raven Stone Thorn Under West Win Yarrow Ash Black Cold Green Long Red White".split()
_PLACES = "field wood ridge combe stead hurst shaw croft dale bury holt mont gate side den water land acre arrow cliff lock ward moor well bridge".split()
_GIVEN = {
    "en": "Amelia Arthur Beatrice Callum Deborah Edmund Fiona Gareth Hannah Imogen Julian Keith Lydia Malcolm Naomi Oliver Philippa Rupert Sheila Tobias Ursula Victor Wendy Aisha Kwame Mei Priya Omar".split(),
    "de": "Anneliese Bernd Carsten Dörte Eberhard Frauke Gisela Holger Ilse Jochen Katrin Lothar Monika Norbert Olaf Petra Rüdiger Sabine Torsten Uwe Waltraud Ayşe Mehmet Zeynep".split(),
    "es": "Adriana Bernardo Carlota Domingo Elvira Fermín Gloria Horacio Inés Joaquín Leticia Mateo Noelia Octavio Pilar Ramiro Silvia Tomás Verónica Xavier Yolanda Andrés Belén Nuria".split(),
    "fr": "Adèle Bastien Capucine Damien Édith Fabrice Gisèle Hugues Inès Jérôme Laurence Maxime Nathalie Odile Pascal Quentin Rachida Sylvie Thibault Vincent Yvette Zoé Mamadou Fatou".split(),
}
_FAMILY = {
    "en": "Abbott Barker Coleman Dawson Ellison Fletcher Graham Hughes Ingram Jennings Kendall Lawson Mitchell Norris Osborne Palmer Quigley Reeves Sinclair Turner Vaughan Watkins Okafor Nguyen Sharma Haddad".split(),
    "de": "Albrecht Bachmann Conrad Dietrich Ehlers Fischer Grabowski Hartmann Jansen Krüger Lehmann Möller Neumann Oswald Pfeiffer Richter Schreiber Thiele Ullrich Vogt Winkler Yilmaz Demir Nowak".split(),
    "es": "Aguirre Benítez Carrasco Delgado Echeverría Fuentes Gallardo Hidalgo Iglesias Jurado Lozano Márquez Navarrete Ortega Palacios Quintana Robledo Salazar Trujillo Urrutia Villalba Zamora".split(),
    "fr": "Arnaud Blanchard Chevalier Delacroix Étienne Fournier Girard Hébert Joubert Lacombe Mercier Noël Olivier Perrin Renard Simonet Tessier Vasseur Weber Diallo Benali Traoré".split(),
}
#: Names that are ordinary words too.
_COMMON = {
    "en": "Rose Will Mark Grace Summer Frank Baker May Hunter Jasper Rusty Pearl Ivy Faith Miles Dale Cook Hope Joy Drew Rich Chase Page Bishop Young".split(),
    "de": "Ernst Wolf Rose Kaiser Sommer Frank Fuchs Vogel Koch Winter Engel Lang Klein Stein".split(),
    "es": "Paloma Rosa Abril Cruz Luz Candela Soledad Remedios Sol Dolores Mercedes Flores Blanca Reyes".split(),
    "fr": "Rose Octave Marguerite Constant Aimée Olive Clémence Prudence Blanche Petit Reine Pascal Juste Fleur".split(),
}
_COLOURS = "gold silver pink blue green red teal ivory rosa verde azul rojo oro bleu vert rouge doré gelb blau grün silber".split()
_TITLES = {"en": ["Dr. ", "Mr. ", "Ms. ", "Mrs. ", "Prof. ", "Dr "], "de": ["Dr. ", "Herr ", "Frau ", "Prof. ", "Herrn "], "es": ["Dr. ", "Sr. ", "Sra. ", "Dra. ", "don ", "doña "], "fr": ["Dr ", "M. ", "Mme ", "Mlle ", "Me "]}
_TLDS = "com org net example test invalid example.com example.org example.net edu de es fr co.uk io info".split()
_DIGITS = "oh one two three four five six seven eight nine".split()
_WORD_DIGITS = {"en": _DIGITS, "de": "null eins zwei drei vier fünf sechs sieben acht neun".split(), "es": "cero uno dos tres cuatro cinco seis siete ocho nueve".split(), "fr": "zéro un deux trois quatre cinq six sept huit neuf".split()}
_NUMBER_WORDS = "seven nine eleven twelve fourteen seventeen nineteen twenty-one twenty-nine thirty thirty-three forty-two fifty fifty-eight sixty-four seventy eighty-one ninety-six".split()
_STREET_WORDS = {
    "en": "Abbey Barley Cedar Dove Elm Ferry Glebe Hazel Iron Jubilee Kiln Lime Meadow Nettle Oak Priory Queen Rowan Saddler Thistle Upper Victoria Wharf Yew Castle Poplar Cross Sandy".split(),
    "de": "Ahorn Buchen Distel Eichen Flieder Ginster Hopfen Immen Kapellen Lavendel Mohn Nelken Post Rosen Sonnen Tannen Ulmen Veilchen Wiesen Ziegen".split(),
    "es": "Acacias Barranco Cipreses Duque Ermita Ferrocarril Geranios Huerta Jazmín Laurel Mayor Nogal Palmera Real Sauce Tejar Valle Zarza".split(),
    "fr": "Acacias Bouleaux Charmes Dahlias Écoles Forge Genêts Halles Iris Jonquilles Lavande Marronniers Noyers Ormes Pins Remparts Saules Verger".split(),
}
_NOUNS = {
    "en": "printer invoice parcel garage folder hedge boiler badge tray fence carpet kitchen sink ladder desk locker van ticket oven mirror receipt couch bridge blanket violin puzzle jacket helmet engine bucket gold soup".split(),
    "de": "Drucker Rechnung Paket Garage Ordner Hecke Kessel Ausweis Zaun Teppich Spüle Leiter Schrank Wagen Fahrkarte Ofen Spiegel Quittung Sofa Brücke Decke Geige Jacke Helm Motor Eimer Suppe".split(),
    "es": "impresora factura paquete garaje carpeta seto caldera valla alfombra cocina escalera armario furgoneta billete horno espejo recibo sofá puente manta violín chaqueta casco motor cubo sopa".split(),
    "fr": "imprimante facture colis garage dossier haie chaudière clôture tapis cuisine échelle armoire camionnette billet four miroir reçu canapé pont couverture violon veste casque moteur seau soupe".split(),
}
_ROLES = {
    "en": "nurse plumber teacher manager neighbour driver clerk trainer cook guest presenter editor gardener visitor mechanic".split(),
    "de": "Lehrer Fahrer Nachbar Klempner Gärtner Trainer Kunde Gast Redakteur Mechaniker Arzt Wirt".split(),
    "es": "profesor conductor vecino fontanero jardinero entrenador cliente invitado redactor mecánico médico cocinero".split(),
    "fr": "professeur chauffeur voisin plombier jardinier entraîneur client invité rédacteur mécanicien médecin cuisinier".split(),
}
_VERBS = {
    "en": "painted moved borrowed carried sold lost opened washed counted ordered packed dropped lifted measured signed returned tested filmed described".split(),
    "de": "bemalte holte verkaufte verlor öffnete zählte bestellte packte trug maß testete beschrieb brachte suchte fand".split(),
    "es": "pintó movió vendió perdió abrió contó pidió llevó midió probó describió trajo buscó encontró lavó".split(),
    "fr": "peignit déplaça vendit perdit ouvrit compta commanda porta mesura testa décrivit apporta chercha trouva lava".split(),
}
_WHERE = {
    "en": ["in the lobby", "before lunch", "without a word", "after the storm", "near the gate", "for the second time", "at half past nine", "last week", "on a Tuesday", "by mistake"],
    "de": ["im Flur", "vor dem Essen", "ohne ein Wort", "nach dem Sturm", "am Tor", "zum zweiten Mal", "letzte Woche", "am Dienstag", "aus Versehen"],
    "es": ["en el pasillo", "antes de comer", "sin decir nada", "tras la tormenta", "en la puerta", "por segunda vez", "la semana pasada", "el martes", "por error"],
    "fr": ["dans le couloir", "avant le repas", "sans un mot", "après l'orage", "devant la porte", "pour la deuxième fois", "la semaine dernière", "un mardi", "par erreur"],
}
_OPEN = {
    "en": ["", "", "", "Yesterday ", "As agreed, ", "In the end ", "Then ", "Luckily ", "At first ", "Meanwhile ", "Of course ", "Well, ", "So "],
    "de": ["", "", "", "Zum Glück ", "Wie vereinbart ", "Am Ende ", "Dann ", "Zuerst ", "Natürlich ", "Also ", "Inzwischen "],
    "es": ["", "", "", "Ayer ", "Como acordamos, ", "Al final ", "Entonces ", "Por suerte ", "Primero ", "Claro, ", "Mientras tanto "],
    "fr": ["", "", "", "Hier ", "Comme convenu, ", "À la fin ", "Alors ", "Heureusement ", "D'abord ", "Bien sûr, ", "Pendant ce temps "],
}
#: Clauses in which a person may stand: {X} is a name or a role, {o} a thing, {v} a verb, {x} where or when.
_CLAUSES = {
    "en": ["{X} {v} {o} {x}", "{o} was {v} by {X} {x}", "{X} and {X} {v} {o}", "we saw {X} {x}", "they gave {o} to {X}", "{X}'s {w} stood {x}", "nobody {v} {o} for {X}", "I asked {X} about {o}", "{X}, who {v} {o}, went home", "{X} says {o} is late", "it was {X} that {v} {o}", "{o} belongs to {X}", "have you met {X} {x}", "with {X} on the phone, {X} {v} {o}", "thanks to {X} and {X}"],
    "de": ["{X} {v} {o} {x}", "{X} und {X} fanden {o}", "wir sahen {X} {x}", "{o} gehört {X}", "ich fragte {X} nach {o}", "{o} wurde von {X} gebracht", "niemand half {X} {x}", "{X} sagt, {o} kommt später", "kennst du {X} {x}", "mit {X} und {X} {x}", "danke an {X}", "{X}, der {o} {v}, ging heim"],
    "es": ["{X} {v} {o} {x}", "{X} y {X} encontraron {o}", "vimos a {X} {x}", "{o} es de {X}", "pregunté a {X} por {o}", "{o} fue traído por {X}", "nadie ayudó a {X} {x}", "{X} dice que {o} llega tarde", "¿conoces a {X} {x}", "con {X} y {X} {x}", "gracias a {X}", "{X}, que {v} {o}, se fue"],
    "fr": ["{X} {v} {o} {x}", "{X} et {X} ont trouvé {o}", "on a vu {X} {x}", "{o} est à {X}", "j'ai demandé {o} à {X}", "{o} fut apporté par {X}", "personne n'a aidé {X} {x}", "{X} dit que {o} arrive tard", "connais-tu {X} {x}", "avec {X} et {X} {x}", "merci à {X}", "{X}, qui {v} {o}, est parti"],
}
_THE = {"en": ["the ", "a ", "the old ", "his ", "one "], "de": ["den ", "das ", "die ", "ein ", "sein "], "es": ["el ", "la ", "un ", "su ", "una "], "fr": ["le ", "la ", "un ", "son ", "une "]}
_WHO = {"en": ["the {r}", "a {r}", "our {r}", "someone", "she", "they"], "de": ["der {r}", "ein {r}", "unser {r}", "jemand", "sie"], "es": ["el {r}", "un {r}", "nuestro {r}", "alguien", "ella"], "fr": ["le {r}", "un {r}", "notre {r}", "quelqu'un", "elle"]}

# Frames that are trained on, then those that are held out.
_PLAIN = {
    "en": (["Our opening hours have changed for {n} days.", "Chop {n} onions and stir the {w} slowly.", "Lot {n}: one {w}, slightly worn", "The {w} needs {n} volts, not more.", "Turn left at the second {w} and keep going.", "Who left the {w} in the fridge?", "At {t} the {w} started to smoke.", "Ladies and gentlemen, dinner is served.", "Please read the terms below.", "Yours, a happy customer", "Morning all,", "To whom it concerns,", "PARKING PERMIT", "Sizes S to XL, {n} colours", "Out of stock until {n} June", "We lost {n} to {n} on penalties.", "Take two tablets with water.", "Figure {n} shows a {w} on top of a {w}."],
           ["The lift is out of order until {t}.", "Only {n} seats are left on the ferry.", "A {w} costs less than a {w} these days.", "NOTICE TO ALL RESIDENTS", "Kind wishes from the whole choir"]),
    "de": (["Unsere Öffnungszeiten haben sich geändert.", "{n} Zwiebeln hacken und langsam rühren.", "Posten {n}: ein {w}, leicht gebraucht", "Der {w} braucht {n} Volt.", "Wer hat die {w} im Kühlschrank gelassen?", "Um {t} fing der {w} an zu rauchen.", "Meine Damen und Herren, es ist angerichtet.", "Ein zufriedener Kunde", "PARKAUSWEIS", "Lieferbar ab {n}. Juni", "Zwei Tabletten mit Wasser einnehmen."],
           ["Der Aufzug ist bis {t} außer Betrieb.", "Nur noch {n} Plätze auf der Fähre.", "AUSHANG FÜR ALLE MIETER"]),
    "es": (["Nuestro horario ha cambiado {n} días.", "Pique {n} cebollas y remueva despacio.", "Lote {n}: una {w} algo usada", "La {w} necesita {n} voltios.", "¿Quién dejó la {w} en la nevera?", "A las {t} el {w} empezó a echar humo.", "Señoras y señores, la cena está servida.", "Un cliente contento", "PERMISO DE APARCAMIENTO", "Agotado hasta el {n} de junio", "Tome dos pastillas con agua."],
           ["El ascensor no funciona hasta las {t}.", "Solo quedan {n} asientos en el barco.", "AVISO A LOS VECINOS"]),
    "fr": (["Nos horaires ont changé pour {n} jours.", "Hachez {n} oignons et remuez doucement.", "Lot {n} : une {w} un peu usée", "La {w} demande {n} volts.", "Qui a laissé la {w} au frigo ?", "À {t}, le {w} s'est mis à fumer.", "Mesdames et messieurs, le dîner est servi.", "Un client ravi", "CARTE DE STATIONNEMENT", "Épuisé jusqu'au {n} juin", "Prenez deux comprimés avec de l'eau."],
           ["L'ascenseur est en panne jusqu'à {t}.", "Il ne reste que {n} places sur le ferry.", "AVIS AUX LOCATAIRES"]),
}
#: Numbers, names of things, handles and list words that are no personal items.
_DECOYS = {
    "en": (["Order {d8} shipped in {n} boxes.", "ISBN 978-{d1}-{d3}-{d5}-{d1}, second printing", "Serial no. SN-{d4}-{d6}, firmware {n}.{n}.{n}", "Ticket {d5} was closed on 2025-{m2}-{m2}.", "Meter reading {d6}, tariff {d3}-{d4}", "Ask @{h} or look under #{h}.", "The {W} {W} Show returns on channel {n}.", "Try the new {W} {w} by {W}!", "Bus {n} stops every {n} minutes.", "IP 10.{n}.{n}.{n} port {d4}", "Total: {n}.{d2} plus {n} percent tax", "{C} is a word you will find on page {n}.", "Will you close the door? Mark the box that applies.", "The grace period ends in May; rose bushes bloom in summer.", "To be frank, a hunter saw the {c} {w}.", "Prices rose by {n} percent, says the {W} report.", "A {c} coloured {w} and a {c} {w}", "May we come in? {C} or not, bring the {w}.", "Paint {n}: {C} White, {C} Grey or plain {c} gold", "{C} White is on sale, {C} Violet is not.", "{C} {K} and {C} {K} clash on wall {n}.", "A {C} {K} scarf or a {c} {k} one?", "{C} replies are rare, {C} things are common.", "{C} {w} for sale", "{C} words, {c} deeds", "Is {c} {k} or {C} {K} the shade for {t}?", "Does {c} gold suit {C}? Will it dry by {t}?", "Invoice {d8}-{d4} was paid twice.", "Parity {d8} is wrong.", "Token {d8} and key {d8} differ.", "Dear neighbours,", "Good evening,", "Hello everyone,", "To the editors,", "Job {d8}-{d4} failed after {n} s.", "{W} {W} Live sold {n} tickets.", "Catalogue {d6}-{d2}, box {n}", "{W} City beats {W} United {n} to {n}.", "The {W} Museum and the {W} Theatre are closed.", "File {h}_{d4}.pdf has {d5} bytes.", "Room {d3}, row {n}, seat {n}", "Model {W}-{d4} weighs {n} kg.", "Read {W} Weekly, issue {n}, page {n}.", "Chapter {n} verse {n}, line {d3}", "{C} {w}, {c} {w} and {n} other flavours", "Card ending in {d4} was declined.", "Account balance {d5}.{d2} on {m2}.{m2}.2024", "Flight {U}{d3} boards at {t}.", "Set {d2}-{d2}-{d2} opens no door.", "Have you seen {W} Mountain on Monday Night {W}?", "{C} morning, {c} evening: the {w} smells the same."],
           ["Container {d6} sits in yard {n}.", "Subscribe to {W} {W} Radio on {n}.{d1} FM.", "Follow us: @{h}", "Revision {d8} replaces sheet {d3}-{d4}.", "{C} paint dries in {n} hours, they say.", "Only one {c} {w} was sold."]),
    "de": (["Bestellung {d8} in {n} Kartons", "ISBN 978-3-{d3}-{d5}-{d1}, zweite Auflage", "Seriennummer SN-{d4}-{d6}", "Zählerstand {d6}, Tarif {d3}-{d4}", "Frag @{h} oder suche #{h}.", "Die {W} {W} Schau läuft auf Sender {n}.", "Bus {n} fährt alle {n} Minuten.", "Im {C} und im Mai blüht die Rose.", "Ein ernster Wolf sah den {w} im Sommer.", "Der Fuchs, der Vogel und der Koch im Märchen", "Farbe {n}: {C} Weiß oder {C} Grau", "{C} {K} und {c} {k} vertragen sich.", "{C} ist heute selten.", "Vorgang {d8}-{d4} ist erledigt.", "Liebe Nachbarn,", "Guten Abend,", "Hallo zusammen,", "Kennzahl {d8} fehlt.", "Liebe Mannschaft,", "Das Duo {W} {W} spielt auf Bühne {n}.", "Das {W} Museum ist zu.", "Flug {U}{d3} startet um {t}.", "Modell {W}-{d4} wiegt {n} kg.", "Raum {d3}, Reihe {n}, Platz {n}", "Saldo {d5},{d2} am {m2}.{m2}.2024", "Karte mit Endziffern {d4} abgelehnt", "{C} und {c}: zwei Wörter auf Seite {n}"],
           ["Container {d6} steht auf Hof {n}.", "Abonniert {W} {W} Radio.", "Blatt {d3}-{d4} ersetzt Stand {d8}.", "Ein {c}er Anstrich trocknet in {n} Stunden."]),
    "es": (["Pedido {d8} en {n} cajas", "ISBN 978-84-{d3}-{d4}-{d1}, segunda edición", "Número de serie SN-{d4}-{d6}", "Lectura {d6}, tarifa {d3}-{d4}", "Pregunta a @{h} o busca #{h}.", "El show {W} {W} vuelve al canal {n}.", "El bus {n} pasa cada {n} minutos.", "En {c} una paloma cruza la luz del sol.", "La rosa y la cruz de la candela", "Pintura {n}: {C} Blanco o {c} gris", "{C} {K} y {c} {k} no pegan.", "{C} es palabra común.", "El trámite {d8}-{d4} está cerrado.", "Queridos vecinos:", "Buenas tardes,", "Hola a todos,", "Falta la clave {d8}.", "El dúo {W} {W} toca en la sala {n}.", "El Museo {W} está cerrado.", "Vuelo {U}{d3}, salida a las {t}.", "Modelo {W}-{d4}, {n} kg", "Sala {d3}, fila {n}, asiento {n}", "Saldo {d5},{d2} el {m2}/{m2}/2024", "Tarjeta terminada en {d4} rechazada", "{C} y {c}: dos palabras de la página {n}"],
           ["El contenedor {d6} está en el patio {n}.", "Escucha {W} {W} Radio.", "La hoja {d3}-{d4} sustituye a {d8}.", "La pintura {c} seca en {n} horas."]),
    "fr": (["Commande {d8} en {n} cartons", "ISBN 978-2-{d3}-{d5}-{d1}, deuxième édition", "Numéro de série SN-{d4}-{d6}", "Relevé {d6}, tarif {d3}-{d4}", "Demande à @{h} ou cherche #{h}.", "Le show {W} {W} revient sur la chaîne {n}.", "Le bus {n} passe toutes les {n} minutes.", "Une rose, une olive et une marguerite en {c}", "La prudence et la clémence du juge", "Peinture {n} : {C} Blanc ou {c} gris", "{C} {K} et {c} {k} jurent.", "{C} est un mot courant.", "Le dossier {d8}-{d4} est clos.", "Chers voisins,", "Bonsoir,", "Salut tout le monde,", "Il manque la clé {d8}.", "Le duo {w} {w} joue salle {n}.", "Le musée {W} est fermé.", "Vol {U}{d3}, départ à {t}.", "Modèle {W}-{d4}, {n} kg", "Salle {d3}, rang {n}, siège {n}", "Solde {d5},{d2} le {m2}/{m2}/2024", "Carte finissant par {d4} refusée", "{C} et {c} : deux mots de la page {n}"],
           ["Le conteneur {d6} est dans la cour {n}.", "Écoutez {W} {W} Radio.", "La feuille {d3}-{d4} remplace {d8}.", "La peinture {c} sèche en {n} heures."]),
}
_ITEMS = {
    "en": (["I am {N}, tenant of flat {n}.", "This is {N} speaking, my extension moved, dial {P}.", "Patient: {N}, born 1971, {I}", "Deliver to {N}, {A}, {T}", "Bill to: {N}\n{A}\n{z}{T}", "{N} signed for the parcel at {t}.", "Contact person {N} ({P})", "For refunds write to {E}.", "My new address is {A}, {z}{T}.", "We moved to {A} in spring.", "The keys are with {G} at {A}.", "Call me back on {P}, {G}", "Emergency contact: {N}, {P}", "Applicant {N}, {I}, {E}", "{I} was copied from the card of {N}.", "His {I} expired; ask {G} for a new one.", "Dear {N},", "Dear {G},", "Sincerely,\n{N}", "Cheers, {G}", "Thank you\n{N}\n{P}\n{E}", "Thanks {G}, see you Monday.", "Hey {G}!", "Good job, {G} and {G}!", "{G}, could you forward this to {E}?", "Tell {N} that the {w} arrived.", "{N} and {N} were elected to the board.", "The report by {N} lists {n} faults.", "According to {N}, the {w} was fine.", "{N} plays cello, {N} sings.", "Photo: {N}", "Coach {N} blamed the {w}.", "{N}: I never saw that {w}.", "{G}: yes, call {P}", "Login {E}, backup {E}", "fax {P}, mobile {P}", "ring {P} after {t}", "Text or call {P}", "{E} bounced, so I tried {E}.", "mail me: {E}", "Reply to {E} before noon.", "Member {n}: {N}, {A}, {P}", "Witness {N} of {A} stated: no {w}.", "The landlord, {N}, lives at {A}.", "Meet us at {A}.", "Come to {A} at {t}.", "The house at {A} was sold to {N}.", "Pick-up: {A}", "{N} | {P} | {E} | {A}", "{N}; {I}; {A}", "{N}, {E}, {P}", "Name {N} Tel {P} Mail {E}", "{n}. {N} - {E}", "Guest list: {N}, {N}, {N}, {G}", "Staff: {G}, {G} and {N}", "{N}'s {w} is broken.", "{G}'s sister {G} phoned from {P}.", "I spoke with {N} about the {w}.", "Was {G} there? No, only {N}.", "It says {N} on the envelope, {A}.", "Please add {I} for {N}.", "ID check: {I}", "She gave {I} at the desk.", "{N} ({I}) passed the exam.", "Send {w} to {A}; invoice to {E}.", "cc: {N} <{E}>", "To: {E}\nFrom: {E}\nSubject: {w}", "[{N}] joined; [{G}] left", "Signed, {N}, {A}", "Interview with {N}, {n} minutes", "Our plumber {N} can be reached at {P}.", "When {G} called {P}, {N} answered.", "spelled {E} on the phone", "write to {E} or just ring {P} any time", "{A} is the old place, {A} the new one."],
           ["Could {N} please report to reception?", "The {w} was repaired by {N} for free.", "{N} has a spare key, number {P}.", "Forward invoices to {E}, not to {E}.", "Our office: {A}, {T}.", "She lives above the bakery at {A}.", "Passenger {N} carries {I}.", "{I} must be shown on arrival.", "Hello {G}, is {P} still right?", "love, {G}", "{N} wrote this poem in {T}.", "Shift plan: {N} early, {N} late", "Voicemail from {P}: call {N}.", "Owner: {N} / {A} / {P}", "{G} thinks {N} forgot the {w}.", "use {E} for the waiting list", "We spoke with {N} about the broken {w}."]),
    "de": (["Ich bin {N}, Mieter der Wohnung {n}.", "Hier spricht {N}, Durchwahl {P}.", "Patient: {N}, {I}", "Lieferung an {N}, {A}, {T}", "Rechnung an: {N}\n{A}\n{z}{T}", "{N} nahm das Paket um {t} an.", "Ansprechpartner {N} ({P})", "Schreiben Sie an {E}.", "Meine neue Adresse ist {A}, {z}{T}.", "Wir sind in die {A} gezogen.", "Der Schlüssel liegt bei {G} in der {A}.", "Ruf mich an: {P}, {G}", "Im Notfall: {N}, {P}", "Antrag von {N}, {I}, {E}", "Liebe {G},", "Lieber {N},", "Ihr {N}", "Gruß {G}", "Danke\n{N}\n{P}\n{E}", "Danke {G}, bis morgen!", "Na {G}?", "Gut gemacht, {G}!", "Sag {N}, dass der {w} da ist.", "{N} und {N} wurden gewählt.", "Laut {N} war der {w} in Ordnung.", "Foto: {N}", "{N}: Den {w} habe ich nie gesehen.", "Fax {P}, mobil {P}", "{E} kam zurück, darum {E}.", "Mitglied {n}: {N}, {A}, {P}", "Zeuge {N} aus der {A}", "Treffpunkt: {A}", "{N} | {P} | {E} | {A}", "Gästeliste: {N}, {N}, {G}", "Ich sprach mit {N} über den {w}.", "War {G} dabei? Nein, nur {N}.", "Bitte {I} für {N} eintragen.", "Sie legte {I} vor.", "Unser Klempner {N} hat die Nummer {P}.", "{n}. {N} - {E}", "Das Haus {A} gehört {N}.", "an {E} oder telefonisch {P}"],
           ["{N} möge sich bitte am Empfang melden.", "Der {w} wurde von {N} repariert.", "Unser Büro: {A}, {T}.", "Fahrgast {N} hat {I} dabei.", "Hallo {G}, stimmt {P} noch?", "Eigentümer: {N} / {A} / {P}", "Rechnungen nur an {E}.", "{G} meint, {N} vergaß den {w}."]),
    "es": (["Soy {N}, inquilino del piso {n}.", "Habla {N}, mi extensión es {P}.", "Paciente: {N}, {I}", "Entregar a {N}, {A}, {T}", "Facturar a: {N}\n{A}\n{z}{T}", "{N} firmó el paquete a las {t}.", "Persona de contacto {N} ({P})", "Para devoluciones escriba a {E}.", "Mi nueva dirección es {A}, {z}{T}.", "Nos mudamos a {A} en otoño.", "Las llaves las tiene {G} en {A}.", "Llámame al {P}, {G}", "En caso de urgencia: {N}, {P}", "Solicitud de {N}, {I}, {E}", "Querida {G}:", "Querido {N}:", "Atentamente,\n{N}", "Besos, {G}", "Gracias\n{N}\n{P}\n{E}", "¡Gracias {G}, hasta el lunes!", "¿Dónde está {N}?", "¡Felicidades, {G}!", "Dile a {N} que llegó la {w}.", "{N} y {N} fueron elegidos.", "Según {N}, el {w} estaba bien.", "Foto: {N}", "{N}: yo nunca vi esa {w}.", "fax {P}, móvil {P}", "{E} devolvió el correo; probé {E}.", "Socio {n}: {N}, {A}, {P}", "El testigo {N} de {A}", "Recogida: {A}", "{N} | {P} | {E} | {A}", "Lista de invitados: {N}, {N}, {G}", "Hablé con {N} sobre el {w}.", "¿Estaba {G}? No, solo {N}.", "Añada {I} para {N}.", "Ella mostró {I} en la entrada.", "Nuestro fontanero {N} atiende en el {P}.", "{n}. {N} - {E}", "La casa de {A} es de {N}.", "a {E} o por teléfono al {P}"],
           ["Que {N} pase por recepción.", "El {w} lo reparó {N} gratis.", "Nuestra oficina: {A}, {T}.", "El pasajero {N} lleva {I}.", "Oye {G}, ¿sigue valiendo el {P}?", "Dueño: {N} / {A} / {P}", "Facturas solo a {E}.", "{G} cree que {N} olvidó la {w}."]),
    "fr": (["Je suis {N}, locataire du logement {n}.", "Ici {N}, mon poste est le {P}.", "Patient : {N}, {I}", "Livrer à {N}, {A}, {T}", "Facturer à : {N}\n{A}\n{z}{T}", "{N} a signé pour le colis à {t}.", "Personne à contacter {N} ({P})", "Pour un remboursement, écrivez à {E}.", "Ma nouvelle adresse est {A}, {z}{T}.", "On a déménagé au {A} en automne.", "Les clés sont chez {G}, {A}.", "Rappelle-moi au {P}, {G}", "En cas d'urgence : {N}, {P}", "Demande de {N}, {I}, {E}", "Chère {G},", "Cher {N},", "Bien à vous,\n{N}", "Bises, {G}", "Merci\n{N}\n{P}\n{E}", "Merci {G}, à lundi !", "Bravo, {G} !", "Où est {N} ?", "Dis à {N} que la {w} est là.", "{N} et {N} ont été élus.", "Selon {N}, le {w} allait bien.", "Photo : {N}", "{N} : je n'ai jamais vu cette {w}.", "fax {P}, portable {P}", "{E} ne marche pas, j'ai essayé {E}.", "Membre {n} : {N}, {A}, {P}", "Le témoin {N}, {A}", "Retrait : {A}", "{N} | {P} | {E} | {A}", "Liste des invités : {N}, {N}, {G}", "J'ai parlé avec {N} du {w}.", "{G} était là ? Non, seulement {N}.", "Ajoutez {I} pour {N}.", "Elle a montré {I} à l'accueil.", "Notre plombier {N} répond au {P}.", "{n}. {N} - {E}", "La maison du {A} est à {N}.", "à {E} ou par téléphone au {P}"],
           ["{N} est prié de passer à la réception.", "Le {w} a été réparé par {N} gratuitement.", "Notre bureau : {A}, {T}.", "Le passager {N} présente {I}.", "Salut {G}, le {P} est toujours bon ?", "Propriétaire : {N} / {A} / {P}", "Factures seulement à {E}.", "{G} croit que {N} a oublié la {w}."]),
}
_SLOT = re.compile(r"\{(\w+)\}")
KINDS = {"N": "name", "G": "name", "E": "email", "P": "phone", "I": "id_number", "A": "address"}


def frames() -> list[str]:
    """All frames, trained on and held out."""
    return [f for table in (_PLAIN, _DECOYS, _ITEMS) for both in table.values() for part in both for f in part] + [c for part in _CLAUSES.values() for c in part]


def literals(frame: str, least: int = 12) -> list[str]:
    """The parts of a frame between its slots, of at least some length."""
    return [p.strip() for p in _SLOT.sub("\0", frame).split("\0") if len(p.strip()) >= least]


@functools.cache
def vocabulary(folder: str = TOKENIZERS) -> dict[str, list[str]]:
    """The words in lower case among the tokens of two public vocabularies: English ones, and ones of many languages."""

    def words(name: str) -> list[str]:
        with open(f"{folder}/{name}", "rb") as f:
            tokens = [base64.b64decode(line.split()[0]).decode("utf-8", "replace") for line in f]
        return [t[1:] for t in tokens if re.fullmatch(r" [a-zà-öø-ÿß]{4,14}", t)]

    english, many = words("byte_bpe_50k.tiktoken"), words("byte_bpe_multi_50k.tiktoken")
    return {lang: english if lang == "en" else many for lang in _LANGS}


def _part(values: list, held: bool) -> list:
    """Three quarters of a stock to train on, or the quarter that is held out."""
    return [v for i, v in enumerate(values) if (i % 4 == 1) == held]


class Writer:
    """Writes labelled windows: (text, [(start, end, type)], [(start, end) of words listed in a lexicon])."""

    def __init__(self, seed: int, neutral: list[str] = (), held_out: bool = False, folder: str = TOKENIZERS):
        """neutral: texts without personal items, cut into the windows as they are. held_out: frames, names,
        syllables and streets that training never sees, written out as they are."""
        self.r, self.neutral, self.held, self.folder = random.Random(seed), list(neutral), held_out, folder

    def pick(self, values: list):
        return self.r.choice(_part(values, self.held))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def any_word(self, lang: str, like: str = "a") -> str:
        """An ordinary word, in capitals as `like` is."""
        word = self.r.choice(vocabulary(self.folder)[lang])
        return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[0].isupper() else word

    def exchanged(self, text: str, lang: str) -> str:
        """text with some of its ordinary words exchanged; slots stay."""
        share = self.r.choice([0, 0, 0.3, 0.6, 0.9])
        return re.sub(r"\{\w+\}|[^\W\d_]{4,}", lambda m: m[0] if m[0][0] == "{" or self.r.random() >= share else self.any_word(lang, m[0]), text)

    def loose(self, lang: str, items: int) -> str:
        """Ordinary words in any order, with so many items between them."""
        r, out = self.r, []
        for _ in range(r.randint(3, 12)):
            roll = r.random()
            capital = "A" if roll < (0.35 if lang == "de" else 0.04) else "a"
            out.append(r.choice(FUNCTION_WORDS[lang]) if r.random() < 0.45 else self.any_word(lang, capital))
            if r.random() < 0.04:
                out.append(" ".join(self.any_word(lang, r.choice(["A", "AA"])) for _ in range(r.choice([1, 2, 2]))))
            if r.random() < 0.05:
                out.append(r.choice(["{n}", "{d4}", "{d8}-{d4}", "{t}", "{d6}-{d1}", "{d8}", "{d3}-{d4}", "@{h}"]))
        for _ in range(items):
            out.insert(r.randint(0, len(out)), r.choice(["{N}", "{N}", "{N}", "{G}", "{G}", "{P}", "{E}", "{A}", "{I}"]) + r.choice(["", "", "", ",", ";", ":", "'s" if lang == "en" else "", "?", " -"]))
        text = " ".join(w + (r.choice([",", ".", ":", " -", "!"]) if r.random() < 0.07 else "") for w in out)
        return text[0].upper() + text[1:] + r.choice([".", ".", "!", "?", ""])

    def fields(self, lang: str) -> str:
        """Labels and items, as in a form or a list."""
        r = self.r
        apart, label = r.choice(["\n", "\n", " | ", "; ", ", ", " / ", " - "]), r.choice([": ", ": ", " ", " = ", " - ", ""])
        parts = []
        for _ in range(r.randint(1, 4)):
            words = " ".join(self.any_word(lang, r.choice(["A", "A", "a", "AA"])) for _ in range(r.choice([1, 1, 2])))
            slot = r.choice(["{N}", "{N}", "{P}", "{E}", "{A}", "{I}", "{G}", "{d5}", "{A}" + r.choice([", ", "\n"]) + "{z}{T}"])
            parts.append((words + label if label else "") + slot)
        return apart.join(parts)

    def made(self, lang: str, most: int = 3) -> str:
        """A word of syllables with an ending of the language; in training also one of any syllables, the head of
        one ordinary word with the tail of another, or an ordinary word, so that the surroundings decide."""
        r, roll = self.r, self.r.random()
        if not self.held and roll < 0.35:
            head, tail = self.any_word(lang), self.any_word(lang)
            return (head[: r.randint(2, 5)] + tail[-r.randint(2, 6) :]).capitalize()
        if not self.held and roll < 0.45:
            return self.any_word(lang, "A")
        if not self.held and roll < 0.7:
            part = lambda: r.choice("b bl br c ch cl d dr f fl g gl gr h j k kl l m n p pr qu r s sch sh st t th tr v w wh y z".split()) + r.choice("a e i o u ai au ea ee ie oa ou é ö ü á".split()) + r.choice(["", "", "l", "n", "r", "s", "t", "ck", "nd", "rt", "ll", "m", "x"])
            return ("".join(part() for _ in range(r.choice([1, 2, 2, most]))) + r.choice(self.r.choice(list(_ENDS.values())))).capitalize()
        word = "".join(self.pick(_SYLLABLES[lang]) for _ in range(self.r.choice([1, 2, 2, 2 if self.held else most]))) + self.r.choice(_ENDS[lang])
        return (word if len(word) > 2 else word + "ra").capitalize()

    def word(self, lang: str, family: bool = False) -> str:
        r, roll = self.r, self.r.random()
        if roll < (0.06 if family else 0.16):
            return r.choice(_COMMON[lang])
        if roll < (0.2 if family else 0.4):
            return self.pick((_FAMILY if family else _GIVEN)[lang])
        if family and roll < 0.36:
            return self.pick(_STEMS) + r.choice(["", "", "s"]) + self.pick(_PLACES)
        word = self.made(lang, 3 if family else 2)
        if family and r.random() < 0.08:
            word = r.choice(["O'", "D'", "Mc", "Mac", "L'"]) + word
        return word

    def name(self, lang: str) -> tuple[str, str]:
        """(title, name): nothing of the title in the name."""
        r = self.r
        of = lang if r.random() < 0.85 else r.choice(_LANGS)
        given, family = self.word(of), self.word(of, True)
        roll = r.random()
        if roll < 0.12:
            family += "-" + self.word(of, True)
        elif roll < 0.16:
            family = {"en": "van ", "de": "von ", "es": "de ", "fr": "de "}[of] + family
        elif roll < 0.2 or of == "es" and roll < 0.3:
            family += " " + self.word(of, True)
        if r.random() < 0.06:
            given += r.choice(["-", " "]) + self.word(of)
        initial = r.choice("ABCDEFGHIJKLMNOPRSTUVWÉ") + "."
        text = r.choice([f"{given} {family}"] * 7 + [f"{family}, {given}"] * 2 + [f"{family.upper()} {given}", f"{given} {initial} {family}", f"{initial} {family}", f"{given[0]}. {family}", f"{given} {family[0].upper()}.", family, given, f"{given} {family.upper()}"])
        roll = r.random()
        text = text.upper() if roll < 0.06 else text.lower() if roll < 0.14 else text
        return (r.choice(_TITLES[lang]) if r.random() < 0.12 else ""), text

    def domain(self) -> str:
        r = self.r
        word = lambda: r.choice([self.made("en"), self.made(r.choice(_LANGS)), r.choice(_NOUNS["en"])]).lower()
        plain = re.sub(r"[^a-z0-9-]", "", r.choice([word(), word(), f"{word()}-{word()}", f"{word()}{r.randint(1, 99)}"])) or "post"
        return (r.choice(["mail.", "office.", "team.", "web."]) if r.random() < 0.2 else "") + plain + "." + r.choice(_TLDS)

    def email(self, lang: str) -> str:
        r = self.r
        plain = str.maketrans("áéíóúñüöäßçèêëûâîôàœ", "aeiounuoasceeeuaioao")
        clean = lambda w: re.sub(r"[^a-z-]", "", w.lower().translate(plain)) or "box"
        given, family, n = clean(self.word(lang)), clean(self.word(lang, True)), self.digits(r.choice([2, 3]))
        user = r.choice([f"{given}.{family}", f"{given[0]}{family}", f"{given}_{family}{n}", f"{family}{n}", f"{given}+{r.choice(_NOUNS['en'])}", f"{given}-{family}", f"{given}{n}", f"{given}.{family}{n}", r.choice(["info", "office", "sales", "hello", "team"])])
        domain, how = self.domain(), r.random()
        if how < 0.6:
            text = f"{user}@{domain}"
        elif how < 0.68:
            text = f"{user} @ {domain}"
        elif how < 0.76:
            text = f"{user} (at) {domain}"
        elif how < 0.82:
            text = f"{user}[at]{domain.replace('.', '[dot]')}"
        elif how < 0.86:
            text = f"{user} AT {domain.replace('.', ' DOT ')}"
        elif how < 0.89:
            text = f"{user}(at){domain.replace('.', '(dot)')}"
        else:
            at, dot, line = {"en": ("at", "dot", "underscore"), "de": ("at", "punkt", "unterstrich"), "es": ("arroba", "punto", "guion bajo"), "fr": ("arobase", "point", "tiret bas")}[lang if r.random() < 0.5 else "en"]
            spoken = user.replace(".", f" {dot} ").replace("_", f" {line} ").replace("+", " plus ")
            text = f"{spoken} {at} {domain.replace('.', f' {dot} ')}"
        return text.upper() if r.random() < 0.05 else text

    def phone(self, lang: str) -> str:
        r, d = self.r, self.digits
        area = r.choice(["202", "312", "415", "617", "808", "212", "646", d(3)])
        if r.random() < 0.12:
            words = _WORD_DIGITS[lang if r.random() < 0.3 else "en"]
            say = lambda s: " ".join(words[int(x)] for x in s)
            return f"{say(area)}, {say('555' if r.random() < 0.7 else d(3))}, {say('01' + d(2))}"
        a, b = ("555" if r.random() < 0.6 else d(3)), d(4)
        if lang == "en":
            options = [f"{area}-{a}-{b}", f"({area}) {a}-{b}", f"{area}.{a}.{b}", f"+1 ({area}) {a}-{b}", f"+1{area}{a}{b}", f"{area} {a} {b} ext. {d(2)}", f"{area}-{a}-{b} x{d(3)}", f"020 7946 0{d(3)}", f"(020) 7946-0{d(3)}", f"+44 20 7946 0{d(3)}", f"004420794{d(5)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(6)}", f"1-{area}-{a}-{b}"]
        elif lang == "de":
            n = d(5)
            options = [f"030 {n} {d(3)}", f"+49 30 {n}{d(3)}", f"030/{n}-{d(3)}", f"0049 30 {n} {d(3)}", f"+49 (0)30 {n} {d(3)}", f"017{d(1)} {d(7)}", f"+49 17{d(1)} {d(7)}", f"(0{d(3)}) {d(6)}", f"0{d(3)} {d(6)}-{d(2)}"]
        elif lang == "es":
            options = [f"600 00 {d(2)} {d(2)}", f"600-000-{d(3)}", f"+34 600 000 {d(3)}", f"600000{d(3)}", f"0034 900 00 {d(2)} {d(2)}", f"6{d(2)} {d(3)} {d(3)}", f"+34 9{d(2)} {d(2)} {d(2)} {d(2)}", f"9{d(1)} {d(3)} {d(2)} {d(2)}"]
        else:
            options = [f"01 99 00 {d(2)} {d(2)}", f"01-99-00-{d(2)}-{d(2)}", f"+33 6 39 98 {d(2)} {d(2)}", f"06.39.98.{d(2)}.{d(2)}", f"+331{d(8)}", f"0199 {d(6)}", f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"0033 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 (0){r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}"]
        return r.choice(options)

    def identity(self, lang: str) -> tuple[str, str]:
        """(words before, number)."""
        r, d = self.r, self.digits
        up = lambda n=1: "".join(r.choice("ABCDEFGHJKLMNPRSTVWXYZ") for _ in range(n))
        if lang == "en":
            options = [("SSN ", f"9{d(2)}-{d(2)}-{d(4)}"), ("social security number ", f"9{d(2)} {d(2)} {d(4)}"), ("SSN on file: ", f"9{d(8)}"), ("", f"9{d(2)}-{d(2)}-{d(4)}"), ("passport no. ", f"X{d(8)}"), ("passport ", f"ZQ{d(7)}"), ("passport ", f"{up()}{d(8)}"), ("NI number ", f"QQ {d(2)} {d(2)} {d(2)} C"), ("national insurance ", f"QQ{d(6)}{up()}"), ("tax ID ", f"{d(2)}-{d(7)}"), ("ID card ", f"{up(2)}{d(7)}")]
        elif lang == "de":
            options = [("Steuer-ID ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("Steuer-Identifikationsnummer: ", d(11)), ("Sozialversicherungsnummer ", f"{d(2)} {d(6)} {up()} {d(3)}"), ("Ausweisnummer ", f"{up()}{d(2)}{up()}{d(3)}{up()}{d(1)}"), ("Reisepass Nr. ", f"C{d(3)}{up()}{d(4)}"), ("Personalausweis ", f"L{d(2)}{up(2)}{d(4)}"), ("Reisepass ", f"{up()}{d(2)}{up()}{d(3)}{up()}{d(1)}"), ("", f"{d(2)} {d(6)} {up()} {d(3)}"), ("", d(11))]
        elif lang == "es":
            options = [("DNI ", f"{d(8)}{up()}"), ("DNI: ", f"{d(2)}.{d(3)}.{d(3)}-{up()}"), ("NIE ", f"X-{d(7)}-{up()}"), ("NIE ", f"Y{d(7)}{up()}"), ("pasaporte ", f"ZAB{d(6)}"), ("pasaporte n.º ", f"{up(3)}{d(6)}"), ("", f"{d(8)}-{up()}"), ("número de la Seguridad Social ", f"{d(2)}/{d(8)}/{d(2)}")]
        else:
            a = r.choice("12")
            month = f"{r.randint(1, 12):02d}"
            options = [("numéro de sécurité sociale ", f"{a} {d(2)} {month} 99 {d(3)} {d(3)} {d(2)}"), ("n° de sécu ", f"{a}-{d(2)}-{month}-99-{d(3)}-{d(3)}-{d(2)}"), ("NIR : ", f"{a}{d(14)}"), ("passeport n° ", f"{d(2)}XZ{d(5)}"), ("carte d'identité ", d(12)), ("", f"{a} {d(2)} {month} 99 {d(3)} {d(3)} {d(2)}"), ("passeport ", f"{d(2)}{up(2)}{d(5)}")]
        return r.choice(options)

    def address(self, lang: str) -> str:
        r, n = self.r, str(self.r.randint(1, 250))
        w = lambda: self.pick(_STREET_WORDS[lang]) if r.random() < 0.5 else self.pick(_STEMS) if lang == "en" and r.random() < 0.4 else self.word(lang, True)
        if lang == "en":
            street = " ".join([w() for _ in range(r.choice([1, 2, 2]))] + [r.choice(["St.", "St", "Street", "Rd", "Road", "Ave", "Avenue", "Lane", "Ln", "Court", "Crescent", "Drive", "Terrace", "Close", "Way", "Place", "Square"])])
            number = r.choice([n] * 5 + [n + "B", n + "a", f"{n}-12", r.choice(_NUMBER_WORDS)])
            text = f"{number} {street}"
        elif lang == "de":
            text = w() + r.choice(["straße", "str.", "gasse", "weg", "allee", "platz", "ring", "steig", "ufer"]) + " " + r.choice([n, n, n + "a", n + " b"])
            text = text if r.random() < 0.85 else r.choice([f"Am {w()}hof {n}", f"Zum {w()}berg {n}", f"An der {w()} {n}"])
        elif lang == "es":
            street = r.choice(["Calle", "C/", "Camino", "Plaza", "Avda.", "Avenida", "Paseo", "Ronda", "Travesía"]) + " " + r.choice(["", "", "del ", "de la ", "de las ", "de los "]) + " ".join(w() for _ in range(r.choice([1, 2])))
            text = street + r.choice([" ", ", ", " nº ", ", n.º "]) + n
        else:
            text = n + r.choice(["", "", " bis", " ter"]) + r.choice([" ", ", "]) + r.choice(["rue", "avenue", "bd", "boulevard", "impasse", "chemin", "allée", "place", "quai", "sentier"]) + " " + r.choice(["du ", "de la ", "des ", "de l'", ""]) + " ".join(w() for _ in range(r.choice([1, 2])))
        roll = r.random()
        return text.lower() if roll < 0.08 else text.upper() if roll < 0.11 else text

    def town(self, lang: str) -> str:
        r = self.r
        end = {"en": ["ton", "bridge", " Bay", "mouth", "bury"], "de": ["dorf", "hausen", "stadt", "burg"], "es": ["", "blanca", " del Mar", "illa"], "fr": ["ville", "-sur-Lys", "court", ""]}[lang]
        return r.choice(["", "", {"en": "Port ", "de": "Bad ", "es": "Santa ", "fr": "Saint-"}[lang]]) + self.made(lang, 2) + r.choice(end)

    def clause(self, lang: str, named: float) -> str:
        """A clause with slots left for the names; each person in it is a name with a chance of `named`."""
        r = self.r
        thing = lambda: r.choice(_THE[lang]) + r.choice(_NOUNS[lang])
        who = lambda: r.choice(["{N}", "{N}", "{N}", "{G}"]) if r.random() < named else r.choice(_WHO[lang]).replace("{r}", r.choice(_ROLES[lang]))
        fill = {"X": who, "v": lambda: r.choice(_VERBS[lang]), "o": thing, "x": lambda: r.choice(_WHERE[lang]), "w": lambda: r.choice(_NOUNS[lang])}
        text = _SLOT.sub(lambda m: fill[m[1]](), self.pick(_CLAUSES[lang]))
        text = r.choice(_OPEN[lang]) + text
        if r.random() < 0.25:
            text += r.choice([", ", {"en": " and ", "de": " und ", "es": " y ", "fr": " et "}[lang], {"en": " because ", "de": ", und ", "es": " porque ", "fr": " car "}[lang]]) + self.clause(lang, named)
        return text

    def sentence(self, lang: str, kind: str) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
        r = self.r
        if kind in ("clause", "told"):
            template = self.clause(lang, 0.0 if kind == "told" else 0.75)
            template = (template if r.random() < 0.1 else template[0].upper() + template[1:]) + r.choice([".", ".", ".", ".", "!", "?", "...", ";", ""])
        elif kind in ("loose", "words"):
            template = self.loose(lang, 0 if kind == "words" else r.choice([1, 1, 2]))
        elif kind == "fields":
            template = self.fields(lang)
        elif kind == "heading":
            template = r.choice([" ", " ", " - "]).join(self.any_word(lang, like) for like in r.choice([["A"], ["A", "a"], ["AA"], ["AA"]]) * r.randint(1, 3))
        else:
            template = r.choice({"plain": _PLAIN, "decoy": _DECOYS, "item": _ITEMS}[kind][lang][self.held])
        if not self.held and kind not in ("loose", "words", "fields", "heading") and not re.search(r"\{[WCc]\}", template):
            template = self.exchanged(template, lang)  # without their words, a thing's name and a person's look the same
        out, spans, listed, at = "", [], [], 0
        for m in _SLOT.finditer(template):
            out += template[at : m.start()]
            at, slot = m.end(), m[1]
            if slot in ("N", "G"):
                title, text = self.name(lang) if slot == "N" else ("", self.word(lang) if r.random() < 0.85 else self.word(lang).lower())
                out += title
            elif slot == "I":
                words, text = self.identity(lang)
                out += words
            elif slot in KINDS:
                text = {"E": self.email, "P": self.phone, "A": self.address}[slot](lang)
            else:
                text = {
                    "w": lambda: r.choice(_NOUNS[lang]), "n": lambda: str(r.randint(1, 999)), "t": lambda: f"{r.randint(0, 23)}:{r.randint(0, 59):02d}", "h": lambda: (r.choice(_NOUNS["en"]) + r.choice(_NOUNS["en"]) + r.choice(["", self.digits(2)])),
                    "W": lambda: r.choice([self.word(lang, True), r.choice(_NOUNS[lang]).capitalize(), self.any_word(lang, "A"), self.any_word(lang, "A")]), "C": lambda: r.choice(_COMMON[lang]), "c": lambda: r.choice(_COMMON[lang]).lower(), "T": lambda: self.town(lang),
                    "z": lambda: self.digits(5) + " " if r.random() < 0.6 else "", "K": lambda: r.choice(_COLOURS).capitalize(), "k": lambda: r.choice(_COLOURS), "U": lambda: r.choice("ABCDKLMRTX") + r.choice("ABEFHKLMZ"), "m2": lambda: f"{r.randint(1, 12):02d}", **{f"d{k}": lambda k=k: self.digits(k) for k in (1, 2, 3, 4, 5, 6, 8)},
                }[slot]()
            if slot in KINDS:
                spans.append((len(out), len(out) + len(text), KINDS[slot]))
                if slot in ("N", "G"):
                    listed += [(len(out) + x.start(), len(out) + x.end()) for x in re.finditer(r"[^\W\d_]{2,}(?:'[^\W\d_]+)?", text) if r.random() < LISTED_NAME]
            elif slot in ("C", "c") and r.random() < 0.8:
                listed.append((len(out), len(out) + len(text)))
            out += text
        out += template[at:]
        if not spans:
            low = {w.lower() for w in _COMMON[lang]}
            listed += [x.span() for x in re.finditer(r"[^\W\d_]{3,}", out) if r.random() < (0.7 if x[0].lower() in low else LISTED_WORD)]
        return out, spans, listed

    def noise(self) -> str:
        """Machine text full of digits: subtitle times, hashes, code, tables."""
        r, d = self.r, self.digits
        hexa = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
        kind = r.randrange(7)
        if kind == 0:
            return "\n".join(f"00:{d(2)}:{d(2)}{r.choice('.,')}{d(3)} --> 00:{d(2)}:{d(2)}.{d(3)} #{d(5)}" for _ in range(r.randint(1, 5)))
        if kind == 1:
            return r.choice([";", " ", "\n", ","]).join(hexa(4) for _ in range(r.randint(6, 30)))
        if kind == 2:
            return f"def mix_{r.choice(['layers', 'tracks'])}({r.choice(['batch', 'xs'])}): return sum({r.choice(['batch', 'xs'])})"
        if kind == 3:
            return " ".join(d(r.randint(1, 6)) for _ in range(r.randint(4, 20)))
        if kind == 4:
            return "|".join(f"{r.randint(0, 999)}.{d(2)}" for _ in range(r.randint(4, 12)))
        if kind == 5:
            return f"sha256:{hexa(64)} size {d(7)}"
        return f"[{d(2)}:{d(2)}:{d(2)}] frame={d(5)} node_{d(3)} q={r.randint(0, 9)}.{d(1)} id=0x{hexa(8)}"

    def window(self, length: int) -> tuple[str, list[tuple[int, int, str]], list[tuple[int, int]]]:
        """A cut of a text of several sentences of one language."""
        r = self.r
        lang = r.choice(["en", "en", "en", "de", "es", "fr"])
        text, spans, listed = "", [], []
        style = r.choice(["space", "space", "line", "bullet", "turn", "number", "json"])
        while len(text) < length + 120:
            kinds = ["plain", "decoy", "item", "clause", "told", "loose", "words", "fields", "heading", "neutral", "noise"]
            kind = r.choices(kinds, [1, 2, 4, 2, 1.5, *((0, 0, 0, 0) if self.held else (3, 1.5, 1, 1.2)), 5 if self.neutral else 0, 0.5])[0]
            if kind == "neutral":
                s, sp = r.choice(self.neutral), []
                s = self.exchanged(s, lang) if r.random() < 0.3 and "{" not in s else s
                li = [x.span() for x in re.finditer(r"[^\W\d_]{3,}", s) if r.random() < LISTED_WORD]
            elif kind == "noise":
                s, sp, li = self.noise(), [], []
            else:
                s, sp, li = self.sentence(lang, kind)
            speaker = r.choice([self.made("en").upper(), "SPEAKER_" + self.digits(2), "CALLER", "@" + r.choice(_NOUNS["en"]), "user" + self.digits(3), ">"])
            lead = {"space": " ", "line": "\n", "bullet": "\n- ", "turn": f"\n{speaker}{r.choice([': ', ' '])}" if speaker[0] in "@u>" else f"\n{speaker}: ", "number": f"\n{r.randint(1, 12)}. ", "json": '"}\n{"step": 3, "note": "'}[style]
            if style == "turn" and speaker[0] not in "@u>SC":
                lead = "\n" + r.choice(["CALLER", "AGENT", "NURSE", "CLERK"]) + ": "
            if r.random() < 0.15:
                lead = r.choice([" ", "\n\n", "\n", "\n12\n00:04:17,093 --> 00:04:20,101\n", "\n0:37 ", "</p>\n<p>", " | ", "\n## ", "\t"])
            if style == "json" and "\n" in s:  # inside JSON a line break is two characters
                shift = lambda i: i + s.count("\n", 0, i)  # noqa: B023, E731
                sp, li = [(shift(a), shift(b), k) for a, b, k in sp], [(shift(a), shift(b)) for a, b in li]
                s = s.replace("\n", "\\n")
            base = len(text) + len(lead)
            text += lead + s
            spans += [(a + base, b + base, k) for a, b, k in sp]
            listed += [(a + base, b + base) for a, b in li]
        roll = r.random()
        if roll < 0.07:
            text = text.lower() if len(text.lower()) == len(text) else text
        elif roll < 0.11:
            text = text.upper() if len(text.upper()) == len(text) else text
        at = r.randint(0, len(text) - length)
        cut = lambda x: [(max(a - at, 0), min(b - at, length), *k) for a, b, *k in x if b > at and a < at + length]
        return text[at : at + length], cut(spans), cut(listed)
