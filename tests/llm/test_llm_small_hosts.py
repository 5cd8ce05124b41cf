from shelfline.llm import site_style


def test_hosts_of_few_pages_lose_what_repeats_significantly(llm):
    def page(i):
        return f"<body><div class=top>Welcome to us</div><div class=body><p>story {i}</p></div>"

    sizes = {"two.example": 2, "five.example": 5, "six.example": 6, "nine.example": 9}
    rows = [(f"http://{host}/{i}", page(i)) for host, n in sizes.items() for i in range(n)]
    pages = llm.createDataFrame(rows, "url string, html string")
    texts = {r["url"]: r["text"] for r in site_style.extract_main_text(pages, ["url"]).collect()}
    for url, text in texts.items():
        story = f"story {url[-1]}"
        cut = url.startswith(("http://six", "http://nine"))
        assert text == (story if cut else f"Welcome to us\n{story}")
