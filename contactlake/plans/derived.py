"""Inputs derived from the given tables, as SQL that Spark and DuckDB both run.

``shop_pages`` makes one page per customer: eight country domains, every attribute
a contact can sit in, stray quotes, decoys, and a tree of links per site. ``raw_contacts`` makes
one row per order with phone, e-mail and link texts of many shapes. Both grow
with the tables they come from.
"""

from __future__ import annotations

SHOP_PAGES = """
SELECT k AS page_id,
       'https://shop' || CAST(site AS STRING) || '.' || tld || '/c/' || CAST(i AS STRING) AS url,
       '<html><head><link rel="canonical" href="/c/' || CAST(i AS STRING) || '">'
       || CASE WHEN k % 7 = 0 THEN '<meta name="telephone" content="+7 (9' || d2 || ') ' || d7 || '">' ELSE '' END
       || CASE WHEN k % 50 = 0 THEN '<meta http-equiv="refresh" content="0;url=/c/0">' ELSE '' END
       || '<script>var m="js' || CAST(k AS STRING) || '@mail.ru";</script></head><body><!-- no' || CAST(k AS STRING) || '@mail.ru -->'
       || '<a href="/c/' || CAST(i * 2 + 1 AS STRING) || '?ref=x">l</a> <a href="' || CAST(i * 2 + 2 AS STRING) || '#top">r</a>'
       || '<a href="https://other.example.net/x">out</a> '
       || CASE k % 6 WHEN 0 THEN '<div class=o' || chr(39) || 'neil data-size=5"><p>at q' || CAST(k AS STRING) || '@oneil.org </p></div>'
                     WHEN 1 THEN '<p title=it' || chr(39) || 's "draft" lang = en>its' || CAST(k AS STRING) || '@' || seg || '.net </p>'
                     WHEN 2 THEN '<a href=/q"' || CAST(i AS STRING) || '>q</a> '
                     WHEN 3 THEN '<img alt=' || chr(39) || '5" > 4"' || chr(39) || 'class=a/> '
                     ELSE '' END
       || CASE k % 4 WHEN 0 THEN '<a href="mailto:Info' || CAST(k AS STRING) || '@Shop.' || tld || '?subject=hi">m</a> '
                     WHEN 1 THEN '<p data-email="sales@test.com">x</p> '
                     WHEN 2 THEN '<p>Mail u' || CAST(k AS STRING) || '&#64;' || seg || '.org now</p> '
                     ELSE '<p>a b@c</p> ' END
       || CASE k % 5 WHEN 0 THEN '<a href="tel:8 (9' || d2 || ') ' || d7 || '">t</a>'
                     WHEN 1 THEN '<b data-phone="29' || d7 || '">p</b>'
                     WHEN 2 THEN '<p>tel +375 29 ' || substr(d7,1,3) || '-' || substr(d7,4,2) || '-' || substr(d7,6,2) || ' art 494' || d7 || '</p>'
                     WHEN 3 THEN '<p>call 50' || d7 || ' or 1234567890 or 1111111111</p>'
                     ELSE '<p>+44 20 ' || substr(d7,1,4) || ' 7' || substr(d7,5,3) || ' / 555 ' || d7 || '</p>' END
       || '</body></html>' AS html
FROM (SELECT c_custkey AS k,
             c_custkey % 8 AS site,
             CAST(floor(c_custkey / 8.0) AS BIGINT) AS i,
             CASE c_custkey % 8 WHEN 0 THEN 'ru' WHEN 1 THEN 'by' WHEN 2 THEN 'ua' WHEN 3 THEN 'kz'
                  WHEN 4 THEN 'com' WHEN 5 THEN 'de' WHEN 6 THEN 'io' ELSE 'uk' END AS tld,
             lpad(CAST((c_custkey * 7919 + 1234567) % 10000000 AS STRING), 7, '0') AS d7,
             lpad(CAST(c_custkey % 100 AS STRING), 2, '0') AS d2,
             lower(c_mktsegment) AS seg
      FROM {customer}) AS base
"""

ALL_PAGES = (
    """
SELECT page_id * 2 AS page_id, url, html FROM {pages}
UNION ALL
SELECT page_id * 2 + 1 AS page_id, url, html FROM ("""
    + SHOP_PAGES
    + ") AS shop\n"
)

RAW_CONTACTS = """
SELECT k, url,
       CASE k % 40
            WHEN 0 THEN '+7 (9' || d2 || ') ' || d7
            WHEN 1 THEN '8 9' || d2 || ' ' || d7
            WHEN 2 THEN '9' || d2 || d7
            WHEN 3 THEN '7495' || d7
            WHEN 4 THEN '+375 29 ' || d7
            WHEN 5 THEN '29' || d7
            WHEN 6 THEN '37529' || d7
            WHEN 7 THEN '17' || d7
            WHEN 8 THEN '50' || d7
            WHEN 9 THEN '38050' || d7
            WHEN 10 THEN '11' || d7
            WHEN 11 THEN '+380 67 ' || d7
            WHEN 12 THEN d3 || '-' || d7
            WHEN 13 THEN '1' || d3 || d7
            WHEN 14 THEN '494' || d7
            WHEN 15 THEN '+1 ' || d3 || ' ' || d7
            WHEN 16 THEN '+44 20 ' || d7 || '1'
            WHEN 17 THEN '+999' || d7
            WHEN 18 THEN '123456' || d2 || d2
            WHEN 19 THEN '10000000' || d2
            WHEN 20 THEN repeat(d2, 5)
            WHEN 21 THEN d7 || reverse(d7)
            WHEN 22 THEN '+7 1' || d2 || ' ' || d7
            WHEN 23 THEN d3 || d2
            WHEN 24 THEN 'call me'
            WHEN 25 THEN '+33 1 ' || d7 || '2'
            WHEN 26 THEN '+49 30' || d7
            WHEN 27 THEN '+1+' || d3 || '+' || d7
            WHEN 28 THEN d7 || d7 || d7
            WHEN 29 THEN ' +' || d3 || d7
            WHEN 30 THEN repeat(d2, 5) || '7'
            WHEN 31 THEN repeat(substr(d2, 1, 1), 9)
            WHEN 32 THEN d7
            WHEN 33 THEN '+' || d7
            WHEN 34 THEN '1729' || d7
            WHEN 35 THEN '8 800 ' || d7
            WHEN 36 THEN '00' || d3 || d7
            WHEN 37 THEN '+995 ' || d2 || ' ' || d7
            WHEN 38 THEN substr('0123456789012345', 1 + CAST(k % 7 AS INT), 9)
            ELSE NULL END AS phone,
       CASE k % 19
            WHEN 0 THEN 'User.' || d7 || '@Mail.ru'
            WHEN 1 THEN '  ' || d2 || '+tag@GMAIL.COM '
            WHEN 2 THEN repeat('a', 60) || d7 || '@gmail.com'
            WHEN 3 THEN 'info' || d2 || '@example.com'
            WHEN 4 THEN 'info' || d2 || '@mail6.example.com'
            WHEN 5 THEN 'bad!' || d2 || '@shop.ru'
            WHEN 6 THEN 'no-at-' || d7
            WHEN 7 THEN 'x' || d2 || '@com'
            WHEN 8 THEN 'x' || d2 || '@.com'
            WHEN 9 THEN 'x' || d2 || '@shop.com.'
            WHEN 10 THEN 'x' || d2 || '@shop.c'
            WHEN 11 THEN 'a@b' || d2 || '@c.com'
            WHEN 12 THEN '@shop' || d2 || '.com'
            WHEN 13 THEN ''
            WHEN 14 THEN 'x@' || repeat('d', 253) || d2 || '.com'
            WHEN 15 THEN 'x' || d7 || '@yandex.ru'
            WHEN 16 THEN 'x_%-' || d2 || '@my-work.co.uk'
            WHEN 17 THEN 'x' || d2 || '@shop.technology|' || d2
            ELSE NULL END AS email,
       CASE k % 29
            WHEN 0 THEN '/about/' || d2
            WHEN 1 THEN 'page' || d2 || '?x=1#f'
            WHEN 2 THEN '../up/' || d2
            WHEN 3 THEN './here' || d2
            WHEN 4 THEN '?q=' || d2
            WHEN 5 THEN '#top'
            WHEN 6 THEN 'mailto:a@b.cd'
            WHEN 7 THEN 'tel:' || d7
            WHEN 8 THEN 'javascript:void(0)'
            WHEN 9 THEN '//cdn' || d2 || '.net/lib.js'
            WHEN 10 THEN 'HTTP://Host' || d2 || '.com/P/'
            WHEN 11 THEN 'https://x' || d2 || '.org/a/../b/./c'
            WHEN 12 THEN '  /trim' || d2 || '  '
            WHEN 13 THEN ''
            WHEN 14 THEN 'a//b' || d2 || '/'
            WHEN 15 THEN '/a//b' || d2 || '//'
            WHEN 16 THEN 'p' || d2 || ';v=1?x=2'
            WHEN 17 THEN 'http:rel' || d2
            WHEN 18 THEN 'ftp://files' || d2 || '.org/f'
            WHEN 19 THEN '/..//x' || d2 || '/..'
            WHEN 20 THEN 'data:text/plain,x'
            WHEN 21 THEN '../../../z' || d2 || '/.'
            WHEN 22 THEN 'https://shop' || d2 || '.ru:8080/x'
            WHEN 23 THEN 'not-a-url'
            WHEN 24 THEN 'host' || d2 || '.com'
            WHEN 25 THEN '://'
            WHEN 26 THEN '/with space/' || d2
            WHEN 27 THEN 'https://sub.s' || CAST(site AS STRING) || '.ru/x'
            ELSE NULL END AS link
FROM (SELECT k, n, site,
             lpad(CAST(n % 10000000 AS STRING), 7, '0') AS d7,
             lpad(CAST(n % 1000 AS STRING), 3, '0') AS d3,
             lpad(CAST(n % 97 AS STRING), 2, '0') AS d2,
             CASE WHEN n % 41 = 0 THEN 'http://localhost/x'
                  WHEN n % 89 = 0 THEN NULL
                  ELSE CASE n % 3 WHEN 0 THEN 'https' ELSE 'http' END
                       || '://s' || CAST(site AS STRING) || '.'
                       || CASE n % 17 WHEN 0 THEN 'com' WHEN 1 THEN 'by' WHEN 2 THEN 'ua' WHEN 3 THEN 'kz'
                               WHEN 4 THEN 'org' WHEN 5 THEN 'de' WHEN 6 THEN 'io' WHEN 7 THEN 'uk'
                               WHEN 8 THEN 'ge' WHEN 9 THEN 'xx' WHEN 10 THEN 'RU' WHEN 11 THEN 'ru:8080'
                               WHEN 12 THEN 'fr' WHEN 13 THEN 'by' WHEN 14 THEN 'ua' WHEN 15 THEN 'net' ELSE 'ru' END
                       || CASE n % 7 WHEN 0 THEN '' WHEN 1 THEN '/' WHEN 2 THEN '/a/b' WHEN 3 THEN '/a/b/'
                               WHEN 4 THEN '/a/b/c?x=1#y' WHEN 5 THEN '/a/b;p=1' ELSE '/a//b/c.html' END
             END AS url
      FROM (SELECT o_orderkey AS k, o_custkey % 50 AS site,
                   o_orderkey * 7919 + o_custkey * 104729 AS n
            FROM {orders}) AS numbers) AS base
"""
