"""Plain-Python link extraction for the crawl model."""

import re
from urllib.parse import urljoin, urlparse


def links_of(html, url):
    base = f"{urlparse(url).scheme}://{urlparse(url).netloc}"
    found = [urljoin(base, href) for href in re.findall(r'<a href="([^"]*)"', html)]
    return [link for link in found if link.strip()]
